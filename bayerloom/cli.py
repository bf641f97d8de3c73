"""python -m bayerloom.cli [--show-progress] from-cli NODE --key value ! NODE ... | from-file FILE -s key=value ... | list

from-cli NODE --help tells what a node takes.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import graph
from .registry import NODES


def usage(name: str) -> str:
    """What a node is and takes."""
    if name not in NODES:
        raise ValueError(f"there is no node type {name}; there are {', '.join(sorted(NODES))}")
    kind = NODES[name]
    role = "source" if kind.source else "sink" if kind.sink else "transform"
    lines = [f"{name}: a {role}{'' if kind.source else ', with one input'}"]
    if kind.run.__doc__:
        lines.append(kind.run.__doc__.strip())
    return "\n".join([*lines, *(f"  --{k}  {p.described()}" for k, p in kind.parameters.items())])


def main(args: list[str]) -> int:
    progress = False
    if args[:1] in (["--show-progress"], ["-p"]):
        progress, args = True, args[1:]
    if args[:1] == ["list"]:
        for name in sorted(NODES):
            print(usage(name))
        return 0
    if args[:1] == ["from-cli"] and args[1:]:
        part: list[str] = []
        for word in [*args[1:], "!"]:
            if word == "!":
                if part[1:] and part[1] in ("--help", "-h"):
                    print(usage(part[0]))
                    return 0
                part = []
            else:
                part.append(word)
        nodes = graph.parse_inline(args[1:])
    elif args[:1] == ["from-file"] and args[1:]:
        settings = [b for a, b in zip(args, args[1:], strict=False) if a in ("-s", "--set")]
        with open(args[1]) as file:
            nodes = graph.parse_yaml(file.read(), dict(s.split("=", 1) for s in settings))
    else:
        print(__doc__)
        return 2
    for name, report in graph.run(SparkSession.builder.appName("bayerloom").getOrCreate(), nodes, progress).items():
        print(name, report)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
