"""Schemes of items: typed fields with defaults, versions with upgrades, normalisation and validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

TYPES = {"string": "string", "number": "double", "boolean": "boolean", "date": "timestamp", "set": "array<string>", "map": "map<string,string>", "richtext": "string"}


@dataclass(frozen=True)
class FieldDef:
    type: str
    required: bool = False
    default: Column | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"no such field type: {self.type}")


@dataclass(frozen=True)
class Scheme:
    """``upgrade`` maps a field of this version to an expression over the fields of the version before."""

    ns: str
    version: int
    fields: dict[str, FieldDef]
    upgrade: dict[str, Column] = field(default_factory=dict)

    @property
    def marker(self) -> str:
        return f"{self.ns}/{self.version}"

    def all_fields(self) -> dict[str, FieldDef]:
        return self.fields | {"isDeleted": FieldDef("boolean")}

    def dates(self) -> list[str]:
        return [n for n, f in self.all_fields().items() if f.type == "date"]

    def ddl(self) -> str:
        return ", ".join(f"`{n}` {TYPES[f.type]}" for n, f in self.all_fields().items())


def decode(payload: Column, scheme: Scheme) -> Column:
    """A JSON payload as a struct of the scheme's fields; tagged dates and sets are unwrapped."""
    parts = []
    for name, f in scheme.all_fields().items():
        at = lambda p: F.get_json_object(payload, p)
        whole = at(f"$.{name}")
        if f.type == "date":
            secs = F.coalesce(at(f"$.{name}.__v"), whole).cast("double")
            value = F.timestamp_millis(F.round(F.when(secs < 1e12, secs * 1000).otherwise(secs)).cast("bigint"))
        elif f.type == "set":
            value = F.array_sort(F.array_distinct(F.from_json(F.coalesce(at(f"$.{name}.__v"), whole), "array<string>")))
        elif f.type == "map":
            value = F.from_json(whole, "map<string,string>")
        else:
            value = whole.cast(TYPES[f.type])
        parts.append(value.alias(name))
    return F.struct(*parts)


def kinds(scheme: Scheme) -> dict[str, tuple[str, str]]:
    """(kind, Spark type) of each field of a raw record, in which dates are milliseconds."""
    raw = {"date": ("number", "bigint")}
    return {n: raw.get(f.type, (f.type if f.type in ("set", "map") else "scalar", TYPES[f.type])) for n, f in scheme.all_fields().items()}


def raw_record(payload: Column, scheme: Scheme) -> Column:
    """A JSON payload as a struct whose values don't depend on a time zone."""
    r = decode(payload, scheme)
    return F.struct(*[(F.unix_millis(r[n]) if n in scheme.dates() else r[n]).alias(n) for n in scheme.all_fields()])


def typed_record(record: str, scheme: Scheme) -> Column:
    at = lambda n: F.col(f"{record}.{n}")
    return F.struct(*[(F.timestamp_millis(at(n)) if n in scheme.dates() else at(n)).alias(n) for n in scheme.all_fields()])


def normalise(df: DataFrame, scheme: Scheme) -> DataFrame:
    """Empty sets and maps become null; absent fields take their defaults, each over the raw row."""
    new = {}
    for name, f in scheme.all_fields().items():
        value = F.col(name) if name in df.columns else F.lit(None).cast(TYPES[f.type])
        if f.type in ("set", "map"):
            value = F.when(F.size(value) > 0, value)
        new[name] = value if f.default is None else F.coalesce(value, f.default)
    return df.withColumns(new)


def violations(df: DataFrame, scheme: Scheme, payload: str | None = None) -> Column:
    """Names of what is wrong: required fields that are absent, values that don't cast, and unknown payload fields."""
    found = [F.when(F.col(n).isNull(), F.lit(f"missing:{n}")) for n, f in scheme.all_fields().items() if f.required]
    if payload:
        for n, f in scheme.all_fields().items():
            raw = F.get_json_object(payload, f"$.{n}")
            if f.type in ("number", "boolean"):
                found.append(F.when(raw.isNotNull() & raw.try_cast(TYPES[f.type]).isNull(), F.lit(f"type:{n}")))
    out = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    if payload:
        known = F.array(*[F.lit(n) for n in scheme.all_fields()])
        unknown = F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), known)
        out = F.concat(out, F.transform(F.array_sort(unknown), lambda k: F.concat(F.lit("unknown:"), k)))
    return out


class SchemeRegistry:
    def __init__(self):
        self._known: dict[str, dict[int, Scheme]] = {}

    def register(self, scheme: Scheme) -> None:
        self._known.setdefault(scheme.ns, {}).setdefault(scheme.version, scheme)

    def get(self, ns: str, version: int | None = None) -> Scheme | None:
        of = self._known.get(ns, {})
        return of.get(max(of) if version is None else version) if of else None

    def versions(self, ns: str) -> list[int]:
        return sorted(self._known.get(ns, {}), reverse=True)

    def path(self, ns: str, start: int, target: int) -> list[Scheme]:
        """The steps of an upgrade; a gap refuses all of it, and there is no way down."""
        steps = [self.get(ns, v) for v in range(start + 1, target + 1)]
        if None in steps:
            raise ValueError(f"no upgrade path for {ns} from {start} to {target}")
        return steps

    def upgrade(self, df: DataFrame, ns: str, target: int | None = None, version: str = "scheme_version") -> DataFrame:
        """Rows below the target go through each version's projection in one plan; others pass unchanged."""
        target = self.versions(ns)[0] if target is None else target
        low = min(self.versions(ns))
        for v in range(low, target):
            (step,) = self.path(ns, v, v + 1)
            due = F.col(version) == v
            new: dict[str, Column] = {}
            for name, f in step.all_fields().items():
                old = F.col(name) if name in df.columns else F.lit(None).cast(TYPES[f.type])
                up = step.upgrade.get(name)
                value = old if up is None else F.when(due, up).otherwise(old)
                if f.default is not None:
                    value = F.when(due, F.coalesce(value, f.default)).otherwise(value)
                new[name] = value
            df = df.withColumns(new | {version: F.when(due, F.lit(v + 1)).otherwise(F.col(version))})
        return df

    def needs_upgrade(self, ns: str, version: Column) -> Column:
        return version < F.lit(self.versions(ns)[0])


UpgradeStep = Callable[[DataFrame], DataFrame]
