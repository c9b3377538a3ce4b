"""Policy profiles: built-ins on the driver, tenants' profiles as long tables."""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.functions.columns import canonical_lang_py, string_list
from portcullis.functions.profiles import BUILTIN_OVERLAYS, DEFAULT_PROFILE, ENUM_VALUES, HOMELAB

MAX_PROFILES = 256  # profiles compared in one plan; they are literals of the plan


def _type_ok(default, value) -> bool:
    return isinstance(value, list) and all(isinstance(v, str) for v in value) \
        if isinstance(default, list) else isinstance(value, type(default))


@dataclass(frozen=True)
class Profile:
    """A complete policy document. ``Profile.build`` lays settings over the defaults."""
    name: str
    values: dict = field(hash=False)

    @classmethod
    def build(cls, name: str, settings: dict | None = None, base: str = DEFAULT_PROFILE) -> "Profile":
        settings = settings or {}
        unknown = sorted(set(settings) - set(HOMELAB))
        if unknown:
            raise ValueError("unknown keys: " + ", ".join(unknown))
        values = {**HOMELAB, **BUILTIN_OVERLAYS[base], **settings}
        for key, value in values.items():
            if not _type_ok(HOMELAB[key], value):
                raise ValueError(f"{key}: wrong type {type(value).__name__}")
        profile = cls(name, values)
        profile.validate()
        return profile

    @classmethod
    def load(cls, name: str = DEFAULT_PROFILE) -> "Profile":
        if name not in BUILTIN_OVERLAYS:
            raise ValueError(f"unknown built-in profile {name!r} (have: {', '.join(sorted(BUILTIN_OVERLAYS))})")
        return cls.build(name, base=name)

    def validate(self) -> None:
        if not self.values["languages.keep"]:
            raise ValueError('languages.keep must list at least one language or "*"')
        und = self.values["languages.und"]
        if und not in ("keep", "drop") and not und.startswith("assume:"):
            raise ValueError(f"languages.und: {und!r} must be keep, drop or assume:<lang>")
        for key, allowed in ENUM_VALUES.items():
            if self.values[key] not in allowed:
                raise ValueError(f"{key}: {self.values[key]!r} is not one of {'|'.join(allowed)}")

    def __getitem__(self, key: str):
        return self.values[key]

    def derived(self) -> dict:
        """Settings in the form the rules use."""
        und = self["languages.und"]
        return {**{k: v for k, v in self.values.items() if k != "description"},
                "languages.keep_all": "*" in self["languages.keep"],
                "languages.keep_codes": sorted({canonical_lang_py(c) for c in self["languages.keep"]}),
                "languages.assume": canonical_lang_py(und[7:]) if und.startswith("assume:") else ""}


class Settings:
    """Profile settings as Columns: literals for one profile, a choice by name for a sweep."""

    def __init__(self, get, only: Profile | None = None):
        self._get, self.only, self._all = get, only, None

    def __getitem__(self, key: str) -> Column:
        return self._get(key)

    def may(self, key: str) -> bool:
        """False only when every profile of the plan switches ``key`` off."""
        if self._all is not None:
            return any(v[key] for v in self._all)
        return bool(self.only[key])

    @classmethod
    def of(cls, profile: Profile) -> "Settings":
        values = profile.derived()
        return cls(lambda k: _literal(values[k]), profile)

    @classmethod
    def of_profiles(cls, profiles: list[Profile], column: str = "profile") -> "Settings":
        """Settings chosen by the profile named in ``column``; rows carry that name and nothing else."""
        values = {p.name: p.derived() for p in profiles}

        def get(key: str) -> Column:
            names = list(values)
            if all(values[n][key] == values[names[0]][key] for n in names):
                return _literal(values[names[0]][key])
            out = F.when(F.col(column) == names[0], _literal(values[names[0]][key]))
            for n in names[1:-1]:
                out = out.when(F.col(column) == n, _literal(values[n][key]))
            return out.otherwise(_literal(values[names[-1]][key]))

        settings = cls(get)
        settings._all = list(values.values())
        return settings


def _literal(value) -> Column:
    return string_list(value) if isinstance(value, list) else F.lit(value)


def sweep(rows: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Every row once per profile, with a ``profile`` column; use ``Settings.of_profiles`` on it."""
    if len(profiles) > MAX_PROFILES:
        raise ValueError(f"at most {MAX_PROFILES} profiles in one plan")
    return rows.withColumn("profile", F.explode(string_list([p.name for p in profiles])))


# --- profiles as tables -----------------------------------------------------------------------
def builtin_rows(spark: SparkSession) -> DataFrame:
    """profiles(profile, key, value) of the defaults; values are JSON text."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in HOMELAB.items()], "key string, value string")


def resolve_profiles(base: DataFrame, overlays: DataFrame) -> DataFrame:
    """Complete settings of every tenant's profile: what it states, else the default.

    ``base(key, value)`` is the fixed default table, ``overlays(profile, key, value)`` any number
    of rows. The default keys are attached by exploding one small map, not by a cross join."""
    defaults = base.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("d"))
    row = defaults.first()  # the fixed key list, 28 entries
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("default")) for k, v in sorted(row["d"].items())]
    names = overlays.select("profile").distinct()
    grid = names.select("profile", F.explode(F.array(*pairs)).alias("e")).select("profile", "e.*")
    stated = overlays.groupBy("profile", "key").agg(F.max("value").alias("stated"))
    return (grid.join(stated, ["profile", "key"], "left")
                .select("profile", "key", F.coalesce("stated", "default").alias("value"),
                        F.col("stated").isNotNull().alias("stated")))


def unknown_keys(base: DataFrame, overlays: DataFrame) -> DataFrame:
    """Overlay rows with a key the defaults do not have: an error, never ignored."""
    return overlays.join(base.select("key"), "key", "left_anti").select("profile", "key")


def validate_profiles(resolved: DataFrame) -> DataFrame:
    """Violations (profile, key, value): enumerations, the keep list and the und rule."""
    plain = F.regexp_replace("value", '^"|"$', "")
    bad = F.when(F.col("key") == "languages.keep", F.col("value").rlike(r"^\[\s*\]$")).when(
        F.col("key") == "languages.und", ~(plain.isin("keep", "drop") | plain.startswith("assume:")))
    for key, allowed in ENUM_VALUES.items():
        bad = bad.when(F.col("key") == key, ~plain.isin(allowed))
    return resolved.filter(F.coalesce(bad, F.lit(False))).select("profile", "key", "value")
