"""python -m arbordoc validate SCHEMA FILE... | signature SCHEMA [LAYER...] | list DIR | add DIR FILE"""

from __future__ import annotations

import sys
from pathlib import Path

from .functions.letters import to_letters
from .operators.binary import signature
from .operators.reports import problems
from .plans.resolve import Resolver


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    command, first, *rest = args
    resolver = Resolver()
    if command == "validate":
        schema, _, _ = resolver.selected(resolver.add(Path(first).read_text()), [])
        lines = [f"{f}: {p}" for f in rest for p in problems(Path(f).read_text(), schema)]
        print(*lines, sep="\n")
        return int(bool(lines))
    if command == "signature":
        print(to_letters(signature(resolver.add(Path(first).read_text()).root, rest or None)))
        return 0
    if command == "list":
        for f in sorted(Path(first).iterdir()):
            k = resolver.add(f.read_text())
            print(k.schema.name, to_letters(signature(k.root)), *("+" + x.name for x in k.schema.layers))
        return 0
    if command == "add":
        text = Path(rest[0]).read_text()
        (Path(first) / f"{resolver.add(text).schema.name}.schema").write_text(text)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
