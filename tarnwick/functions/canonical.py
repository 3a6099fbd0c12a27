"""Canonical JSON, digests, and what is read out of record texts; pandas UDFs where Spark has no builtin."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .text import BEHAVIOURS

#: Forms of code and images in a text.
FENCE = re.compile(r"```([^\n`]*)\n(.*?)```", re.S)
PRE = re.compile(r"<pre(?:\s[^>]*)?>\s*<code(?:\s[^>]*)?>(.*?)</code>\s*</pre>", re.I | re.S)
IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)(?:\s+['\"][^'\"]*['\"])?\)")
FIELD_KINDS = {"image_text": "image_transcript", "patch": "patch", "poc": "code"}
SEGMENT = ArrayType(StructType([StructField(n, t) for n, t in [*((x, StringType()) for x in ("modality", "extraction", "language", "text", "uri")), ("start", IntegerType()), ("end", IntegerType()), ("normal", StringType()), ("behaviours", ArrayType(StringType()))]]))


def canonical(value: object) -> str:
    """JSON with sorted keys and without blanks; what is no number in JSON is refused."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8")).hexdigest()


def sample_id(kind: str, *parts: object) -> str:
    return f"{kind}-{digest([kind, *parts])[:24]}"


@F.pandas_udf(StringType())
def digest_json(values: pd.Series) -> pd.Series:
    """Digest of the canonical form of JSON text; null for text that is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return digest(json.loads(text)) if text is not None else None
        except ValueError:
            return None

    return values.map(one)


@F.pandas_udf(ArrayType(StringType()))
def distinct_json(values: pd.Series) -> pd.Series:
    """The first of each canonical form among an array's JSON texts, in order."""

    def one(xs: list[str] | None) -> list[str] | None:
        if xs is None:
            return None
        firsts: dict[str, str] = {}
        for x in xs:
            firsts.setdefault(canonical(json.loads(x)), x)
        return list(firsts.values())

    return values.map(one)


def fingerprint(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """n and one digest of all (key, revision) pairs, in any order: two sums of their hashes, so no list is gathered."""
    pair = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.col(revision).cast("string")), 256)
    part = lambda at: F.sum(F.conv(F.substring(pair, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.agg(F.count("*").alias("n"), *[part(at).alias(f"s{at}") for at in (1, 16, 31, 46)])
    return sums.select("n", F.sha2(F.concat_ws(":", "n", *[F.coalesce(F.col(f"s{at}"), F.lit(0)).cast("string") for at in (1, 16, 31, 46)]), 256).alias("fingerprint"))


def normal(text: str) -> str:
    return " ".join(html.unescape(text).split())


def behaviours_of(code: str) -> list[str]:
    low = code.lower()
    return sorted(k for k, p in BEHAVIOURS.items() if re.search(p, low))


def segments(text: str | None, kind: str = "description") -> list[dict]:
    """The whole text of a field, then its fenced code, code elements and images, each with its place in code points."""
    if not text or not text.strip():
        return []
    made = lambda modality, how, own, start, end, language=None, uri=None, code=False: {"modality": modality, "extraction": how, "language": language, "text": own, "uri": uri, "start": start, "end": end, "normal": normal(own), "behaviours": behaviours_of(own) if code else []}
    out = [made(FIELD_KINDS.get(kind, "text"), "source_field", text, 0, len(text))]
    fenced = {m.span(2) for m in FENCE.finditer(text)}
    out += [made("code", "markdown_fence/v1", m[2], *m.span(2), m[1].strip(), code=True) for m in FENCE.finditer(text)]
    out += [made("code", "html_pre_code/v1", html.unescape(re.sub(r"<[^>]+>", "", m[1])), *m.span(1), "", code=True) for m in PRE.finditer(text) if m.span(1) not in fenced]
    return out + [made("image_reference", "markdown_image/v1", m[1].strip(), *m.span(), uri=m[2]) for m in IMAGE.finditer(text)]


@F.pandas_udf(SEGMENT)
def modalities(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    """segments of texts, which are fields of the kinds named."""
    return pd.Series([segments(t, k) for t, k in zip(texts, kinds, strict=True)])


def evidence(records: DataFrame, fields: tuple[str, ...] = ("description", "poc", "patch", "image_text")) -> DataFrame:
    """One row for each segment of each field of records: source, source_id, field, the segment and confidence."""
    rows = records.select("source", "source_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields if f in records.columns])).alias("f"))
    rows = rows.select("source", "source_id", "f.*")
    names = ["source", "source_id", "field", *SEGMENT.elementType.names]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):  # a batch's segments are not held at once
                some = part.iloc[at : at + 256]
                yield pd.DataFrame([(*r[:3], *s.values()) for r in some.itertuples(index=False) for s in segments(r.value, r.field)], columns=names)

    found = rows.mapInPandas(run, StructType([*rows.schema.fields[:3], *SEGMENT.elementType.fields]))
    unsure = (F.col("field") == "image_text") | (F.col("modality") == "image_reference")
    named = F.sha2(F.concat_ws("\x1f", "source", "source_id", "field", "start", "end", "text", F.coalesce("uri", F.lit(""))), 256)
    return found.withColumn("confidence", F.when(unsure, "unverified").when(F.col("extraction") == "source_field", "source_asserted").otherwise("extracted")).withColumn("evidence_id", named)


def alignment(found: DataFrame) -> DataFrame:
    """facet, name and n: evidence by modality, by extraction and by code behaviour, and what is unverified."""
    facets = F.array(F.struct(F.lit("modality").alias("facet"), F.col("modality").alias("name")), F.struct(F.lit("extraction").alias("facet"), F.col("extraction").alias("name")))
    more = F.transform("behaviours", lambda b: F.struct(F.lit("behaviour").alias("facet"), b.alias("name")))
    odd = F.when(F.col("confidence") == "unverified", F.array(F.struct(F.lit("finding").alias("facet"), F.lit("unverified_evidence").alias("name")))).otherwise(F.array().cast("array<struct<facet:string,name:string>>"))
    return found.select(F.explode(F.concat(facets, more, odd)).alias("x")).groupBy("x.facet", "x.name").agg(F.count("*").alias("n"))


VIEW_FIELDS = ("title", "description", "components", "weaknesses", "attack_preconditions", "poc", "patch", "image_text")


def view_texts(records: DataFrame, key: str = "vuln_id") -> DataFrame:
    """key, view and text of the separately searchable views of each record that are not empty."""
    return records.select(key, F.explode(views_of(records, key)).alias("v")).select(key, "v.*")


def views_of(records: DataFrame, key: str) -> Column:
    """The views of a record that are not empty, as an array of structs of view and text.

    records: aliases (array) and such of VIEW_FIELDS and severity as it has, arrays and structs as JSON text. Views: aggregate,
    description, poc, patch, component and metadata; with an array behaviours, behavior as well.
    """
    field = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f in records.columns else F.lit("")
    named = lambda f: F.when(field(f) != "", F.concat(F.lit(f"{f}: "), field(f)))
    lines = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")
    aliases = F.array_join("aliases", " ") if "aliases" in records.columns else F.lit("")
    each = F.array_join("aliases", "\n") if "aliases" in records.columns else F.lit("")
    acts = F.array_join(F.array_sort(F.array_distinct("behaviours")), " ") if "behaviours" in records.columns else F.lit("")
    views = {
        "aggregate": lines(F.col(key).cast("string"), each, *[named(f) for f in VIEW_FIELDS], F.when(acts != "", F.concat(F.lit("code_behaviors: "), acts))),
        "description": lines(field("title"), field("description"), field("image_text")),
        "poc": field("poc"), "patch": field("patch"), "component": field("components"), "behavior": acts,
        "metadata": lines(F.concat(F.lit(f"{key}: "), F.col(key).cast("string")), F.when(aliases != "", F.concat(F.lit("aliases: "), aliases)), *[named(f) for f in ("title", "weaknesses", "severity", "attack_preconditions")]),
    }
    all_views = F.array(*[F.struct(F.lit(v).alias("view"), text.alias("text")) for v, text in views.items()])
    return F.filter(all_views, lambda x: F.trim(x["text"]) != "")
