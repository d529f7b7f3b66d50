"""A prompt for statements: ``python -m tessera.store.cli FOLDER``."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from tessera.session import local_session
from tessera.store.session import Engine

HELP = "Statements end at the end of a line.  .help shows this, .exit or .quit ends.\n"


def repl(engine: Engine, lines: Iterable[str], write) -> None:
    session = engine.session()
    for line in lines:
        text = line.strip()
        if text in (".exit", ".quit"):
            return
        if text == ".help":
            write(HELP)
        elif text:
            write(session.execute(text))
        write("(txn) > " if session.base is not None else "> ")


if __name__ == "__main__":
    repl(Engine(local_session(), sys.argv[1]), sys.stdin, lambda s: print(s, end="", flush=True))
