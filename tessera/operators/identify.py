"""Which format a blob is in: signatures and further tests with confidences, and the best one for each blob.

A signature rule holds where all its tests do; a probe gives a confidence by looking closer. Of
several, the one of the highest confidence wins, and of equal ones that of the format registered
first. All are columns of one pass over the beginnings of blobs; neither a join nor a shuffle takes place.
"""

from __future__ import annotations

import json
from base64 import b64encode
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.reading import extension
from tessera.operators import signatures
from tessera.operators.probes import ANSWERS, PROBES, probed


@dataclass(frozen=True)
class Rule:
    """format; its place in the order of registration; confidence; tests: (offset, values) of which one must stand there; suffixes that a file name must have one of; sizes of the blob, as (least, most)."""

    format: str
    order: int
    confidence: int
    tests: tuple[tuple[int, tuple[bytes, ...]], ...] = ()
    suffixes: tuple[str, ...] = ()
    sizes: tuple[tuple[int, int], ...] = ()


def _bytes(value: str) -> bytes:
    return value[1:-1].replace("_", " ").encode("latin-1") if value[0] == "'" else bytes.fromhex(value)


def parse(text: str) -> list[Rule]:
    """Rules from lines as described in the module signatures."""
    out = []
    for line in text.strip().splitlines():
        order, name, confidence, *tests = line.split()
        at, suffixes, sizes, least, most = [], (), [], 0, 1 << 62
        for test in tests:
            if test[0] == ".":
                suffixes = tuple(test[1:].split("|"))
            elif test.startswith("len="):
                sizes = [(int(n), int(n)) for n in test[4:].split("|")]
            elif test.startswith("len<="):
                most = int(test[5:])
            elif test.startswith("len>="):
                least = int(test[5:])
            else:
                offset, values = test.split(":", 1)
                at.append((int(offset), tuple(_bytes(v) for v in values.split("/"))))
        if (least, most) != (0, 1 << 62):
            sizes = [(least, most)]
        out.append(Rule(name, int(order), int(confidence), tuple(at), suffixes, tuple(sizes)))
    return out


RULES: list[Rule] = [*parse(signatures.CONTAINERS), *parse(signatures.IMAGES), *parse(signatures.OTHERS)]

#: Other names of formats.
ALIASES = {"applesingle": "applesd", "appledouble": "applesd"}


def format_name(name: str) -> str:
    """The registered format that a name or an alias stands for, whatever its case."""
    name = name.lower()
    return ALIASES.get(name, name)


def registry(spark, rules: list[Rule] = RULES) -> DataFrame:
    """The formats that are told by a signature or a probe: format, order, rules (signatures), best (their highest confidence, null for probes alone)."""
    rows = [(r.format, r.order, r.confidence, 1) for r in rules] + [(name, order, None, 0) for name, (order, _) in PROBES.items()]
    return spark.createDataFrame(rows, "format string, `order` int, confidence int, n int").groupBy("format", "order").agg(F.sum("n").alias("rules"), F.max("confidence").alias("best"))


SCHEMA = "array<struct<format:string,order:int,confidence:int,tests:array<struct<at:int,values:array<binary>>>,suffixes:array<string>,sizes:array<struct<least:long,most:long>>>>"


def as_value(rules: list[Rule]) -> Column:
    """Rules as one constant array, so that plans stay small however many there are."""
    coded = [
        {"format": r.format, "order": r.order, "confidence": r.confidence, "tests": [{"at": at, "values": [b64encode(v).decode() for v in values]} for at, values in r.tests],
         "suffixes": list(r.suffixes), "sizes": [{"least": a, "most": b} for a, b in r.sizes]}
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(coded)), SCHEMA)


def rules_that_hold(rules: list[Rule], content: str = "content", path: str = "path") -> Column:
    """An array of struct (confidence, before, format) of the rules that hold: before grows with earlier registration."""
    blob, size = F.col(content), F.octet_length(content)
    ending = extension(path)

    def stands(test: Column, value: Column) -> Column:
        place, n = F.when(test["at"] < 0, size + test["at"]).otherwise(test["at"]), F.octet_length(value)
        return (place >= 0) & (F.rpad(F.substring(blob, place + 1, n), n, bytes(1)) == value)

    def holds(rule: Column) -> Column:
        sizes = (F.size(rule["sizes"]) == 0) | F.exists(rule["sizes"], lambda s: size.between(s["least"], s["most"]))
        suffix = (F.size(rule["suffixes"]) == 0) | F.array_contains(rule["suffixes"], ending)
        return sizes & suffix & F.forall(rule["tests"], lambda t: F.exists(t["values"], lambda v: stands(t, v)))

    found = F.filter(as_value(rules), lambda r: F.coalesce(holds(r), F.lit(False)))
    return F.transform(found, lambda r: F.struct(r["confidence"].alias("confidence"), (-r["order"]).alias("before"), r["format"].alias("format")))


def _considered(name: str, only: set[str] | frozenset[str] | None, without: set[str] | frozenset[str]) -> bool:
    return (only is None or name in {format_name(x) for x in only}) and name not in {format_name(x) for x in without}


def _answers(blobs: DataFrame, rules: list[Rule], probes: dict) -> DataFrame:
    """blobs with _answers: an array of struct (confidence, before, format)."""
    found = rules_that_hold(rules)
    if not probes:
        return blobs.withColumn("_answers", found)
    return blobs.withColumn("_probed", probed(probes)).withColumn("_answers", F.concat(F.coalesce(found, F.array().cast(ANSWERS)), "_probed")).drop("_probed")


def detections(blobs: DataFrame, rules: list[Rule] = RULES, probes: dict = PROBES) -> DataFrame:
    """path, format, confidence, order for every format that some test tells, with its highest confidence. Blobs of one path keep their own rows."""
    better = lambda x: ~F.exists("_answers", lambda y: (y["format"] == x["format"]) & (y["confidence"] > x["confidence"]))
    best = _answers(blobs.select("path", "content"), rules, probes).select("path", F.explode(F.array_distinct(F.filter("_answers", better))).alias("d"))
    return best.select("path", "d.format", "d.confidence", (-F.col("d.before")).alias("order"))


def with_format(blobs: DataFrame, rules: list[Rule] = RULES, only: set[str] | frozenset[str] | None = None, without: frozenset[str] | set[str] = frozenset(), probes: dict = PROBES) -> DataFrame:
    """blobs with the columns format and confidence of the best answer (null and 0 without one). Rows and other columns stay. only, without: formats (or aliases) to consider or leave out."""
    used = [r for r in rules if _considered(r.format, only, without)]
    looks = {name: p for name, p in probes.items() if _considered(name, only, without)}
    plain = blobs.drop("format", "confidence")
    if not used and not looks:
        return plain.withColumns({"format": F.lit(None).cast("string"), "confidence": F.lit(0)})
    best = _answers(plain, used, looks).withColumn("_best", F.array_max("_answers"))
    return best.withColumns({"format": F.col("_best.format"), "confidence": F.coalesce("_best.confidence", F.lit(0))}).drop("_answers", "_best")


def identify(blobs: DataFrame, rules: list[Rule] = RULES, only: set[str] | frozenset[str] | None = None, without: frozenset[str] | set[str] = frozenset(), probes: dict = PROBES) -> DataFrame:
    """path, format, confidence of every blob; null and 0 where nothing tells a format."""
    return with_format(blobs.select("path", "content"), rules, only, without, probes).select("path", "format", "confidence")
