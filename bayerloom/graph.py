"""Pipelines: from YAML or an inline line to checked nodes, to DataFrames, to sinks.

A graph is checked as a whole before anything runs: names, parameters, cycles
and the kinds of frames on every edge. Frames flow through DataFrames, so a node
that feeds several others is planned once for each; put a Cache behind it to
compute it once.
"""

from __future__ import annotations

import re
import shlex
import sys
import threading
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from .params import resolve
from .registry import NODES, Port, PortError


def _release(made: dict[str, Any]) -> None:
    """Let go of what nodes have cached."""
    for out in made.values():
        for frames in out if isinstance(out, list) else [out]:
            if isinstance(frames, DataFrame) and not frames.isStreaming and frames.is_cached:
                frames.unpersist()


@dataclass
class Node:
    name: str
    type: str
    parameters: dict[str, Any] = field(default_factory=dict)
    inputs: dict[str, str] = field(default_factory=dict)


def fill(text: str, variables: dict[str, str]) -> str:
    """Put variables in place of {{ name }}; a missing one is an error."""

    def value(m: re.Match) -> str:
        if m[1] not in variables:
            raise KeyError(f"the variable {m[1]} isn't set")
        return str(variables[m[1]])

    return re.sub(r"\{\{\s*([\w-]+)\s*\}\}", value, text)


def parse_yaml(text: str, variables: dict[str, str] | None = None) -> list[Node]:
    """name: {type, parameters}; a value <other is an edge from the node `other`."""
    nodes = []
    for name, spec in (yaml.safe_load(fill(text, variables or {})) or {}).items():
        spec = dict(spec or {})
        if "type" not in spec:
            raise ValueError(f"the node {name} has no type")
        node = Node(str(name), spec.pop("type"))
        for key, value in spec.items():
            if isinstance(value, str) and value.startswith("<"):
                node.inputs[key] = value[1:].strip()
            else:
                node.parameters[key] = value
        nodes.append(node)
    return nodes


def parse_inline(line: str | Iterable[str]) -> list[Node]:
    """Node --key value ! Node --key value: a chain, each node fed by the one before."""
    words = shlex.split(line) if isinstance(line, str) else list(line)
    nodes: list[Node] = []
    part: list[str] = []
    for word in [*words, "!"]:
        if word != "!":
            part.append(word)
            continue
        if not part:
            raise ValueError("there is an empty place in the chain")
        kind, given, at = part[0], {}, 1
        while at < len(part):
            if not part[at].startswith("--"):
                raise ValueError(f"{kind}: {part[at]} should be a --parameter")
            if at + 1 < len(part) and not part[at + 1].startswith("--"):
                given[part[at][2:]] = part[at + 1]
                at += 2
            else:
                given[part[at][2:]] = True
                at += 1
        node = Node(f"{len(nodes)}_{kind}", kind, given)
        if nodes:
            node.inputs["input"] = nodes[-1].name
        nodes.append(node)
        part = []
    return nodes


def ordered(nodes: list[Node]) -> list[Node]:
    """Inputs before the nodes that they feed; names, types and cycles are checked."""
    by_name: dict[str, Node] = {}
    for node in nodes:
        if node.name in by_name:
            raise ValueError(f"there are two nodes named {node.name}")
        if node.type not in NODES:
            raise ValueError(f"{node.name}: there is no node type {node.type}; there are {', '.join(sorted(NODES))}")
        by_name[node.name] = node
    out: list[Node] = []
    state: dict[str, int] = {}

    for root in nodes:
        stack = [(root.name, iter(root.inputs.values()))]
        if state.get(root.name):
            continue
        state[root.name] = 1
        while stack:
            name, rest = stack[-1]
            other = next(rest, None)
            if other is None:
                stack.pop()
                state[name] = 2
                out.append(by_name[name])
            elif other not in by_name:
                raise ValueError(f"{name} takes its input from {other}, which isn't there")
            elif state.get(other) == 1:
                raise ValueError(f"there is a cycle through {other}")
            elif not state.get(other):
                state[other] = 1
                stack.append((other, iter(by_name[other].inputs.values())))
    return out


def check(nodes: list[Node]) -> list[tuple[Node, dict]]:
    """The nodes in order with all their parameters, after every edge's port is checked."""
    ports: dict[str, Port | None] = {}
    out = []
    for node in ordered(nodes):
        kind = NODES[node.type]
        if set(node.inputs) != set(kind.inputs):
            raise ValueError(f"{node.name} takes {' and '.join(kind.inputs) or 'no input'}, not {' and '.join(node.inputs) or 'none'}")
        for other in node.inputs.values():
            if NODES[next(n.type for n in nodes if n.name == other)].sink:
                raise PortError(f"{node.name} takes its input from {other}, which is a sink")
        parameters = resolve(node.name, kind.parameters, node.parameters)
        try:
            ports[node.name] = kind.gives(parameters, ports[node.inputs["input"]] if kind.inputs else None)
        except PortError as e:
            raise PortError(f"{node.name} ({node.type}) {e}") from None
        out.append((node, parameters))
    return out


def build(spark: SparkSession, nodes: list[Node]) -> dict[str, Any]:
    """The output of every node that isn't a sink."""
    made: dict[str, Any] = {}
    for node, parameters in check(nodes):
        kind = NODES[node.type]
        if not kind.sink:
            made[node.name] = kind.run(spark, parameters, made[node.inputs["input"]] if kind.inputs else None)
    return made


class Progress:
    """Shows how many tasks of the running stages are done, twice a second, on standard error."""

    def __init__(self, spark: SparkSession, out=None):
        self.tracker, self.out, self.shown = spark.sparkContext.statusTracker(), out or sys.stderr, 0
        self.began, self.stop = time.monotonic(), threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.stop.wait(0.5):
            self.show()

    def show(self) -> None:
        stages = [s for s in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if s]
        for s in stages:
            done = 20 * s.numCompletedTasks // max(s.numTasks, 1)
            self.out.write(f"\r{'#' * done}{'-' * (20 - done)} | {s.numCompletedTasks}/{s.numTasks} tasks of stage {s.stageId} | elapsed: {time.monotonic() - self.began:.0f} s ")
        self.out.flush()
        self.shown += len(stages)

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop.set()
        self.thread.join()
        self.out.write("\n")


def run(spark: SparkSession, nodes: list[Node], show_progress: bool = False) -> dict[str, Any]:
    """Run all sinks, by priority, then in order; gives what each reports. A sink's error is raised after the others are done."""
    if show_progress:
        with Progress(spark):
            return run(spark, nodes)
    checked = check(nodes)
    sinks = [(node, p) for node, p in checked if NODES[node.type].sink]
    if not sinks:
        raise ValueError("the pipeline has no sink")
    made = build(spark, nodes)
    reports, failed = {}, None
    for node, p in sorted(sinks, key=lambda s: s[1].get("priority", 0)):
        try:
            reports[node.name] = NODES[node.type].run(spark, p, made[node.inputs["input"]])
        except Exception as e:  # the first error counts
            failed = failed or e
    if not any(NODES[node.type].lazy for node, _ in sinks):
        _release(made)
    if failed:
        raise failed
    return reports
