"""Who may read what: permissions by relation and column, roles that include others, labels that flow with values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import AccessDenied
from tessera.plans.nodes import Footprint


@dataclass(frozen=True)
class Permission:
    """``action`` on a relation, or on one of its columns."""

    action: str
    relation: str
    column: int | None = None


@dataclass(frozen=True)
class Role:
    name: str
    permissions: frozenset[Permission] = frozenset()
    includes: tuple[str, ...] = ()


def flattened(roles: dict[str, Role], name: str) -> frozenset[Permission]:
    """All permissions of a role with those it includes; a cycle of includes is refused."""

    def down(n: str, path: tuple[str, ...]) -> frozenset[Permission]:
        if n in path:
            raise AccessDenied(f"roles include each other: {' > '.join((*path, n))}")
        if n not in roles:
            raise AccessDenied(f"no role {n}")
        r = roles[n]
        return r.permissions.union(*(down(i, (*path, n)) for i in r.includes))

    return down(name, ())


def authorize(need: Footprint, have: frozenset[Permission]) -> None:
    """Refuse unless every column that a plan reads is permitted."""
    for relation, columns in need.columns:
        if Permission("read", relation) in have:
            continue
        lacking = sorted(c for c in columns if Permission("read", relation, c) not in have)
        if lacking or not columns:
            raise AccessDenied(f"{relation}: columns {lacking}")


def no_new_flows(before: dict[str, frozenset[Permission]], after: dict[str, frozenset[Permission]], origin: dict[tuple[str, int], frozenset[tuple[str, int]]]) -> list[str]:
    """What roles could read after a migration that they couldn't before; ``origin`` gives the old columns each new one is made of."""
    out = []
    for role, perms in after.items():
        old = before.get(role, frozenset())
        for p in perms:
            if p.action != "read":
                continue
            for (rel, col), sources in origin.items():
                if rel == p.relation and p.column in (None, col):
                    out += [f"{role}: {rel}.{col} from {r}.{c}" for r, c in sources if not {Permission("read", r), Permission("read", r, c)} & old]
    return sorted(out)


# labels: an array column of names


def join_labels(*labels: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*labels)))


def select_labels(condition: Column, condition_labels: Column, then: Column, other: Column) -> Column:
    """Labels of a conditional: those of what was chosen and of what chose it."""
    return join_labels(condition_labels, F.when(condition, then).otherwise(other))


def may_flow(labels: Column, clearance: list[str]) -> Column:
    return F.size(F.array_except(labels, F.lit(clearance) if clearance else F.array().cast("array<string>"))) == 0
