"""A recursive descent parser.  Text after the end of a statement is an error, never ignored."""

from __future__ import annotations

from typing import Any

from tessera.plans import tree as t
from tessera.plans.tokens import ParseError, Token, tokenise
from tessera.types import TYPES

AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG")
RANKINGS = ("ROW_NUMBER", "RANK")
#: Words that end an expression or a source and so are no alias.
RESERVED = frozenset("SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET JOIN INNER LEFT RIGHT FULL OUTER CROSS ON AND OR NOT AS ASC DESC IN BETWEEN IS NULL LIKE SET VALUES OVER PARTITION UNION WITH TRUE FALSE INTO USING NATURAL".split())


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokenise(text), 0

    # Tokens

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def advance(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def word(self, *words: str) -> bool:
        """Take the words if they all come next."""
        if all(self.tokens[min(self.at + i, len(self.tokens) - 1)].is_word(w) for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def symbol(self, text: str) -> bool:
        if self.token.kind == "symbol" and self.token.text == text:
            self.at += 1
            return True
        return False

    def fail(self, wanted: str) -> ParseError:
        return ParseError(f"expected {wanted}, found {self.token.text or 'the end'!r} at {self.token.at}")

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise self.fail(" ".join(words))

    def need(self, text: str) -> None:
        if not self.symbol(text):
            raise self.fail(text)

    def name(self) -> str:
        if self.token.kind == "quoted" or self.token.kind == "name" and self.token.text.upper() not in RESERVED:
            return self.advance().text
        raise self.fail("a name")

    def listed(self, item) -> tuple[Any, ...]:
        out = [item()]
        while self.symbol(","):
            out.append(item())
        return tuple(out)

    # Statements

    def statement(self) -> Any:
        out = self._statement()
        self.symbol(";")
        if self.token.kind != "end":
            raise self.fail("the end")
        return out

    def _statement(self) -> Any:
        if self.word("EXPLAIN"):
            return t.Explain(self._statement())
        for word in ("BEGIN", "COMMIT", "ROLLBACK"):
            if self.word(word):
                self.word("TRANSACTION")
                return t.Control(word)
        if self.word("PREPARE"):
            while self.token.kind != "end" and not (self.token.kind == "symbol" and self.token.text == ";"):
                self.advance()
            return t.Control("PREPARE")
        if self.word("CREATE", "TABLE"):
            return self._create_table()
        if self.word("CREATE", "INDEX"):
            name = self.name()
            self.need_word("ON")
            table = self.name()
            self.need("(")
            column = self.name()
            self.need(")")
            kind = "BTREE"
            if self.word("USING"):
                kind = self.name().upper()
                if kind not in ("BTREE", "HASH"):
                    raise ParseError(f"no index kind {kind}")
            return t.CreateIndex(name, table, column, kind)
        if self.word("DROP", "TABLE"):
            return t.DropTable(self.name())
        if self.word("DROP", "INDEX"):
            return t.DropIndex(self.name())
        if self.word("ALTER", "TABLE"):
            return self._alter()
        if self.word("INSERT", "INTO"):
            return self._insert()
        if self.word("DELETE", "FROM"):
            table = self.name()
            return t.Delete(table, self.expression() if self.word("WHERE") else None)
        if self.word("UPDATE"):
            table = self.name()
            self.need_word("SET")
            values = self.listed(self._assignment)
            return t.Update(table, values, self.expression() if self.word("WHERE") else None)
        if self.token.is_word("SELECT", "WITH"):
            return self.query()
        raise self.fail("a statement")

    def _type(self) -> str:
        kind = self.name().upper()
        if kind not in TYPES:
            raise ParseError(f"no type {kind}")
        if self.symbol("("):
            self.advance()
            self.need(")")
        return kind

    def _create_table(self) -> t.CreateTable:
        table, columns = self.name(), ()
        if self.symbol("("):
            columns = self.listed(lambda: (self.name(), self._type()))
            self.need(")")
        if len({c for c, _ in columns}) < len(columns):
            raise ParseError("a column is named twice")
        return t.CreateTable(table, columns)

    def _alter(self) -> t.AlterTable:
        table = self.name()
        action = next((w for w in ("ADD", "DROP", "RENAME") if self.word(w)), None)
        if action is None:
            raise self.fail("ADD, DROP or RENAME")
        self.word("COLUMN")
        column, other = self.name(), None
        if action == "ADD":
            other = self._type()
        elif action == "RENAME":
            self.need_word("TO")
            other = self.name()
        return t.AlterTable(table, action.lower(), column, other)

    def _insert(self) -> t.Insert:
        table, columns = self.name(), ()
        if self.symbol("("):
            columns = self.listed(self.name)
            self.need(")")
        if self.word("VALUES"):
            return t.Insert(table, columns, self.listed(self._row))
        return t.Insert(table, columns, query=self.query())

    def _row(self) -> tuple[Any, ...]:
        self.need("(")
        values = self.listed(self._constant)
        self.need(")")
        return values

    def _constant(self) -> Any:
        value = self.expression()
        if isinstance(value, t.Unary) and value.op == "-" and isinstance(value.operand, t.Literal):
            value = t.Literal(-value.operand.value)
        if not isinstance(value, t.Literal):
            raise ParseError("VALUES takes literals")
        return value.value

    def _assignment(self) -> tuple[str, Any]:
        column = self.name()
        self.need("=")
        return column, self.expression()

    # Queries

    def query(self) -> Any:
        if not self.word("WITH"):
            return self._select()
        steps = self.listed(self._step)
        return t.With(steps, self._select())

    def _step(self) -> tuple[str, Any]:
        name = self.name()
        self.need_word("AS")
        self.need("(")
        body = self.query()
        self.need(")")
        return name, body

    def _select(self) -> t.Select:
        self.need_word("SELECT")
        distinct = self.word("DISTINCT")
        items = self.listed(self._item)
        source = self._source() if self.word("FROM") else None
        joins = []
        while join := self._join():
            joins.append(join)
        where = self.expression() if self.word("WHERE") else None
        group = self.listed(self.expression) if self.word("GROUP", "BY") else ()
        having = self.expression() if self.word("HAVING") else None
        order = self.listed(self._sort_key) if self.word("ORDER", "BY") else ()
        limit = self._count() if self.word("LIMIT") else None
        offset = self._count() if self.word("OFFSET") else 0
        return t.Select(items, source, tuple(joins), where, group, having, order, limit, offset, distinct)

    def _count(self) -> int:
        if self.token.kind != "number" or not self.token.text.isdigit():
            raise self.fail("a whole number")
        return int(self.advance().text)

    def _alias(self) -> str | None:
        if self.word("AS"):
            return self.name()
        if self.token.kind == "quoted" or self.token.kind == "name" and self.token.text.upper() not in RESERVED:
            return self.name()
        return None

    def _item(self) -> t.Item:
        if self.symbol("*"):
            return t.Item(t.Star())
        expression = self.expression()
        return t.Item(expression) if isinstance(expression, t.Star) else t.Item(expression, self._alias())

    def _source(self) -> t.Source:
        if self.symbol("("):
            query = self.query()
            self.need(")")
            return t.Source(None, self._alias(), query)
        return t.Source(self.name(), self._alias())

    def _join(self) -> t.Join | None:
        how = "inner"
        if self.word("CROSS", "JOIN"):
            return t.Join("cross", self._source())
        natural = self.word("NATURAL")
        for side in ("LEFT", "RIGHT", "FULL"):
            if self.word(side):
                how = side.lower()
                self.word("OUTER")
                self.need_word("JOIN")
                break
        else:
            if not (self.word("INNER", "JOIN") or self.word("JOIN")):
                if natural:
                    raise self.fail("JOIN")
                return None
        source = self._source()
        if natural:
            return t.Join(how, source, using=())
        if self.word("USING"):
            self.need("(")
            using = self.listed(self.name)
            self.need(")")
            return t.Join(how, source, using=tuple(using))
        self.need_word("ON")
        return t.Join(how, source, self.expression())

    def _sort_key(self) -> tuple[Any, bool]:
        key = self.expression()
        descending = self.word("DESC")
        if not descending:
            self.word("ASC")
        return key, descending

    # Expressions, from the loosest binding on

    def expression(self) -> Any:
        out = self._conjunction()
        while self.word("OR"):
            out = t.Binary("OR", out, self._conjunction())
        return out

    def _conjunction(self) -> Any:
        out = self._negation()
        while self.word("AND"):
            out = t.Binary("AND", out, self._negation())
        return out

    def _negation(self) -> Any:
        return t.Unary("NOT", self._negation()) if self.word("NOT") else self._comparison()

    def _comparison(self) -> Any:
        out = self._sum()
        if self.token.kind == "symbol" and self.token.text in ("=", "!=", "<>", "<", "<=", ">", ">="):
            return t.Binary(self.advance().text, out, self._sum())
        if self.word("IS", "NULL"):
            return t.Unary("IS NULL", out)
        if self.word("IS", "NOT", "NULL"):
            return t.Unary("IS NOT NULL", out)
        negated = self.word("NOT")
        if self.word("IN"):
            self.need("(")
            inner = t.In(out, (t.Subquery(self.query()),) if self.token.is_word("SELECT", "WITH") else self.listed(self.expression))
            self.need(")")
        elif self.word("BETWEEN"):
            low = self._sum()
            self.need_word("AND")
            inner = t.Between(out, low, self._sum())
        elif self.word("LIKE"):
            inner = t.Binary("LIKE", out, self._sum())
        elif negated:
            raise self.fail("IN, BETWEEN or LIKE")
        else:
            return out
        return t.Unary("NOT", inner) if negated else inner

    def _sum(self) -> Any:
        out = self._product()
        while self.token.kind == "symbol" and self.token.text in ("+", "-", "||"):
            out = t.Binary(self.advance().text, out, self._product())
        return out

    def _product(self) -> Any:
        out = self._signed()
        while self.token.kind == "symbol" and self.token.text in ("*", "/", "%"):
            out = t.Binary(self.advance().text, out, self._signed())
        return out

    def _signed(self) -> Any:
        return t.Unary("-", self._signed()) if self.symbol("-") else self._primary()

    def _primary(self) -> Any:
        token = self.token
        if token.kind == "number":
            self.advance()
            return t.Literal(int(token.text) if token.text.isdigit() else float(token.text))
        if token.kind == "string":
            self.advance()
            return t.Literal(token.text)
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.word(word):
                return t.Literal(value)
        if self.symbol("("):
            inner = t.Subquery(self.query()) if self.token.is_word("SELECT", "WITH") else self.expression()
            self.need(")")
            return inner
        if self.word("CASE"):
            return self._case()
        first = self.name()
        if token.kind == "name" and self.symbol("("):
            if first.upper() == "CAST":
                operand = self.expression()
                self.need_word("AS")
                kind = self._type()
                self.need(")")
                return t.Cast(operand, kind)
            return self._call(first.upper())
        if self.symbol("."):
            return t.Star(first) if self.symbol("*") else t.Name(self.name(), first)
        return t.Name(first)

    def _case(self) -> t.Case:
        operand = None if self.token.is_word("WHEN") else self.expression()
        branches = []
        while self.word("WHEN"):
            condition = self.expression()
            self.need_word("THEN")
            branches.append((condition, self.expression()))
        if not branches:
            raise self.fail("WHEN")
        otherwise = self.expression() if self.word("ELSE") else None
        self.need_word("END")
        return t.Case(operand, tuple(branches), otherwise)

    def _call(self, function: str) -> t.Call:
        if function not in AGGREGATES + RANKINGS:
            raise ParseError(f"no function {function}")
        argument = None
        if not self.symbol(")"):
            argument = t.Star() if self.symbol("*") else self.expression()
            self.need(")")
        if function in RANKINGS:
            if argument is not None:
                raise ParseError(f"{function} takes no argument")
        elif argument is None or isinstance(argument, t.Star) and function != "COUNT":
            raise ParseError(f"{function} needs a column")
        if not self.word("OVER"):
            if function in RANKINGS:
                raise self.fail("OVER")
            return t.Call(function, argument)
        self.need("(")
        partition = self.listed(self.expression) if self.word("PARTITION", "BY") else ()
        order = self.listed(self._sort_key) if self.word("ORDER", "BY") else ()
        self.need(")")
        return t.Call(function, argument, t.Over(partition, order))


def parse(text: str) -> Any:
    return Parser(text).statement()
