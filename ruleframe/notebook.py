"""Notebook cells of rules: ``%load_ext ruleframe.notebook``, then ``%%rules``.

A cell runs in the session given on its line (``%%rules s``), else in one of its
own that is kept from cell to cell.
"""

from __future__ import annotations

from typing import Any

from ruleframe.plans.terms import RuleError
from ruleframe.session import Session


class Failure:
    """An error of a program, shown instead of a traceback."""

    def __init__(self, error: RuleError):
        self.error = error

    def __repr__(self) -> str:
        return f"{type(self.error).__name__}: {self.error}"


def load_ipython_extension(shell: Any) -> None:
    own: list[Session] = []

    def rules(line: str, cell: str) -> Any:
        """Run the cell; the answers of its queries are its result."""
        name = line.strip()
        if name:
            session = shell.user_ns[name]
        else:
            own[:] = own or [Session()]
            session = own[0]
        before = len(session.printed)
        try:
            got = session.query(cell)
        except RuleError as e:
            return Failure(e)
        for text in session.printed[before:]:
            print(text)
        return None if got == [] else got

    shell.register_magic_function(rules, "cell", "rules")
