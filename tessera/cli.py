"""A small shell: statements end with `;`, results are shown as text. Usage: python -m tessera.cli ROOT DATABASE"""

from __future__ import annotations

import sys

from tessera.client import Client
from tessera.session import get_session
from tessera.sql.errors import SqlError


def statements(lines):
    """Texts up to each `;` that stands outside quotes."""
    held, quote = "", ""
    for line in lines:
        for ch in line:
            quote = "" if ch == quote else quote or (ch if ch in "'\"" else "")
            if ch == ";" and not quote:
                if held.strip():
                    yield held.strip()
                held = ""
            else:
                held += ch
    if held.strip():
        yield held.strip()


def main(root: str, name: str, lines, out=print) -> None:
    client = Client(get_session("shell"), root)
    try:
        client.session(name)
    except SqlError:
        client.create_db(name)
    for sql in statements(lines):
        try:
            result = client.execute_query(name, sql)
            if result.df is None:
                out(result.message)
            else:
                out("\t".join(result.df.columns))
                for row in result:
                    out("\t".join("NULL" if v is None else str(v) for v in row))
        except Exception as e:  # the shell goes on after a bad statement
            out(f"Error: {str(e).splitlines()[0]}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], sys.stdin)
