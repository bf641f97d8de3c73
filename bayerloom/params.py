"""Node parameters: kinds, ranges, defaults, and strict reading from text or YAML."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

MANDATORY = object()


@dataclass(frozen=True)
class Parameter:
    """kind: int, float, str, bool or list. Both ends of a range count; without a default the parameter must be given."""

    kind: str
    default: Any = MANDATORY
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def read(self, name: str, value: Any) -> Any:
        """The value as its kind, from YAML or from command-line text; both are checked alike."""
        made = self._typed(name, value)
        if self.kind in ("int", "float") and (self.low is not None and made < self.low or self.high is not None and made > self.high):
            raise ValueError(f"{name} must lie between {self.low} and {self.high}, not {made}")
        if self.choices and made not in self.choices:
            raise ValueError(f"{name} must be one of {', '.join(map(str, self.choices))}, not {made}")
        return made

    def described(self) -> str:
        """Its kind, what it may be, and its default."""
        limits = f" of {', '.join(map(str, self.choices))}" if self.choices else f" from {self.low}" * (self.low is not None) + f" to {self.high}" * (self.high is not None)
        return f"{self.kind}{limits}, {'must be given' if self.default is MANDATORY else f'default {self.default!r}'}"

    def _typed(self, name: str, value: Any) -> Any:
        wrong = ValueError(f"{name} must be of kind {self.kind}, not {value!r}")
        if self.kind == "list":
            return [x.strip() for x in value.split(",") if x.strip()] if isinstance(value, str) else list(value)
        if self.kind == "str":
            return str(value)
        if self.kind == "bool":
            if isinstance(value, bool):
                return value
            if value in ("true", "false", "True", "False"):
                return value.lower() == "true"
            raise wrong
        if isinstance(value, bool):
            raise wrong
        try:
            if self.kind == "int":
                if isinstance(value, float) and value != int(value):
                    raise wrong
                return int(value)
            return float(value)
        except (TypeError, ValueError):
            raise wrong from None


def resolve(node: str, declared: dict[str, Parameter], given: dict[str, Any]) -> dict[str, Any]:
    """All parameters of a node: what is given, read strictly, and defaults; unknown names are errors."""
    if unknown := sorted(set(given) - set(declared)):
        raise ValueError(f"{node} has no parameter {', '.join(unknown)}")
    out = {}
    for name, parameter in declared.items():
        if name in given:
            out[name] = parameter.read(f"{node}.{name}", given[name])
        elif parameter.default is MANDATORY:
            raise ValueError(f"{node} needs the parameter {name}")
        else:
            out[name] = parameter.default
    return out
