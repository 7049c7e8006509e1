"""Feature extractors of external providers: a registry of schemas and column functions.

A provider names the table its payloads come from, the schema of its JSON payload and a
function from the parsed payload to named features. Every provider has its own schema;
payloads are parsed and extracted inside the scan's stage, and a filter on provider or entity
is applied before anything is parsed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provider:
    """A source of external payloads.

    ``features`` maps the parsed payload to columns by feature name; a feature that is null is
    left out, a payload that does not parse gives the single feature ``unparsed``.
    """

    name: str
    source_class: str
    freshness_us: int
    schema: str
    features: Callable[[Column], dict[str, Column]]


REGISTRY: dict[str, Provider] = {}


def register(provider: Provider) -> Provider:
    if provider.name in REGISTRY:
        raise ValueError(f"duplicate provider {provider.name}")
    REGISTRY[provider.name] = provider
    return provider


def extracted(payloads: DataFrame, providers: dict[str, Provider] | None = None) -> DataFrame:
    """Features of raw payloads: ``provider``, ``source_class``, ``entity``, ``observed_us``, ``expires_us``, ``feature``, ``value``.

    ``payloads`` has ``provider``, ``entity``, ``observed_us`` and ``payload`` (JSON text). Rows
    of unknown providers are not dropped: they give the feature ``unknown_provider``.
    """
    providers = REGISTRY if providers is None else providers
    kind = F.col("provider")

    def feature(name, value):
        return F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value"))

    cases = None
    for p in providers.values():
        parsed = F.from_json("payload", p.schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        known = F.filter(F.array(*[feature(n, v) for n, v in p.features(parsed).items()]), lambda x: x["value"].isNotNull())
        empty = reduce(lambda a, b: a & b, [parsed[f.split()[0]].isNull() for f in p.schema.split(", ")])
        found = F.when(parsed.isNull() | empty, F.array(feature("unparsed", F.lit(1.0)))).otherwise(known)
        cases = F.when(kind == p.name, found) if cases is None else cases.when(kind == p.name, found)
    unknown = F.array(feature("unknown_provider", F.lit(1.0)))
    meta = F.create_map(*[F.lit(x) for p in providers.values() for x in (p.name, p.source_class)]) if providers else None
    life = F.create_map(*[F.lit(x) for p in providers.values() for x in (p.name, p.freshness_us)]) if providers else None
    rows = payloads.withColumn("x", F.explode(unknown if cases is None else cases.otherwise(unknown)))
    return rows.select(
        "provider", (F.lit(None).cast("string") if meta is None else F.try_element_at(meta, kind)).alias("source_class"), "entity", "observed_us",
        (F.lit(None).cast("long") if life is None else F.col("observed_us") + F.try_element_at(life, kind)).alias("expires_us"), "x.feature", "x.value")
