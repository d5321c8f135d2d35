"""A small interactive loop and command line: ``python -m ruleframe.repl``.

With arguments it runs a program: ``--import-csv NAME/ARITY PATH`` and
``--export-csv NAME/ARITY PATH`` (any number of them), ``--text PROGRAM`` or a
file, then the program's own arguments.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ruleframe.plans.parser import Parser
from ruleframe.plans.terms import RuleError, SyntaxProblem, show
from ruleframe.session import Answer, Session

HELP = "Statements end with '.', queries with '?'.  Commands: run FILE, reset, help, exit."


def shown(answer: object, most: int = 20) -> str:
    if isinstance(answer, DataFrame):
        return "\n".join(str(r) for r in answer.limit(most).collect()) or "no results"
    if isinstance(answer, Answer):
        return "\n".join(", ".join(f"{n} = {v}" for n, v in zip(answer.variables, r, strict=True)) for r in answer.rows[:most]) or "no results"
    return show(answer) if not isinstance(answer, (list, dict)) else str(answer)


def complete(text: str) -> bool:
    """Whether the text parses and its last statement has ended."""
    if not text.rstrip().endswith((".", "?")):
        return False
    try:
        Parser(text).program()
    except SyntaxProblem:
        return False
    return True


def respond(session: Session, text: str) -> list[str]:
    """Output of one piece of input."""
    before = len(session.printed)
    try:
        got = session.query(text)
    except RuleError as e:
        return [f"{type(e).__name__}: {e}"]
    return session.printed[before:] + [shown(a) for a in (got if isinstance(got, list) else [got])]


def command(argv: list[str], session: Session) -> Session:
    """Run what a command line names; exports follow the program."""
    from ruleframe.sources.csvio import export_csv, import_csv

    rest, exports, text = list(argv), [], None
    while rest and rest[0].startswith("--"):
        flag = rest.pop(0)
        if flag in ("--import-csv", "--export-csv"):
            if len(rest) < 2 or "/" not in rest[0]:
                raise RuleError(f"{flag} takes NAME/ARITY and a path")
            name, arity = rest.pop(0).rsplit("/", 1)
            task = (session, name, int(arity), rest.pop(0))
            if flag == "--import-csv":
                import_csv(*task)
            else:
                exports.append(task)
        elif flag == "--text" and rest:
            text = rest.pop(0)
        else:
            raise RuleError(f"unknown flag {flag}")
    session.arguments = rest[0 if text is not None else 1 :]
    if text is not None:
        session.execute(text)
    elif rest:
        session.run_file(rest[0])
    for task in exports:
        export_csv(*task, file=task_file(session, rest, text))
    return session


def task_file(session: Session, rest: list[str], text: str | None) -> str:
    """The scope that the program's names are in."""
    return "main" if text is not None or not rest else str(Path(rest[0]).resolve())


def main(session: Session | None = None) -> None:
    session, text = session or Session(), ""
    print(HELP)
    while True:
        try:
            line = input("  " if text else "> ")
        except KeyboardInterrupt:
            text = ""
            print()
            continue
        except EOFError:
            return
        word, _, rest = line.strip().partition(" ")
        if not text and word in ("exit", "quit"):
            return
        if not text and word == "help":
            print(HELP)
        elif not text and word == "reset":
            session = Session(session.spark)
        elif not text and word == "run":
            try:
                session.run_file(rest)
            except (RuleError, OSError) as e:
                print(e)
        else:
            text += line + "\n"
            if complete(text) or not line.strip():
                print("\n".join(respond(session, text)))
                text = ""


if __name__ == "__main__":
    if len(sys.argv) > 1:
        made = Session(SparkSession.builder.getOrCreate() if any(a.endswith("-csv") for a in sys.argv) else None)
        print("\n".join(command(sys.argv[1:], made).printed))
    else:
        main()
