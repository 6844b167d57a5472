"""Logical nodes of a spatial plan, in declaration order."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True, eq=False)
class Node:
    """A step; equal only to itself, so that plans share a prefix only if it is the same one."""

    op: str
    args: dict[str, Any]

    @property
    def is_join(self) -> bool:
        return self.op.endswith("_join") or self.op == "intersects_pairs"

    def label(self) -> str:
        shown = []
        for k, v in self.args.items():
            if k == "query":
                shown.append(f"query=[{', '.join(v.columns)}]")
            elif k == "polygon":
                shown.append(f"polygon={sum(len(r) for p in v for r in p)} vertices")
            else:
                shown.append(f"{k}={v}")
        return f"{self.op}({', '.join(shown)})"
