"""Canonical records from source records: identity, priority, three-valued states, provenance, components, and what changed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwick.functions.canonical import canonical, digest
from tarnwick.functions.text import cpe_coordinate, entity_token, purl_coordinate
from tarnwick.sources.records import identity

#: Sources, the preferred first, and the fields that every canonical record has.
PRIORITY = {"cve": 0, "nvd": 1, "avd": 2, "cnnvd": 3}
CORE = ("title", "description", "severity", "weaknesses", "components", "attack_preconditions", "poc", "patch")


def assertions(records: DataFrame) -> DataFrame:
    """vuln_id, field, value (JSON text), prio, source_id, source, url of every filled field of every active record.

    records: the typed columns of a source record, and where there is one, a map `extra` of other fields to JSON text, which count alike.
    """
    own = [c for c in (*CORE, "image_text") if c in records.columns]
    types = dict(records.dtypes)
    text = lambda c: F.to_json(c) if types[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in own])
    if "extra" in records.columns:
        cells = F.concat(cells, F.transform(F.map_entries(F.coalesce("extra", F.expr("cast(map() as map<string,string>)"))), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"))))
    prio = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in PRIORITY.items()], F.lit(len(PRIORITY)))
    active = records.filter("status = 'active'").withColumn("vuln_id", identity()).withColumn("prio", prio)
    rows = active.select("vuln_id", "prio", "source", "source_id", "url", F.explode(cells).alias("c")).select("vuln_id", "prio", "source", "source_id", "url", "c.*")
    return rows.filter("value is not null and value not in ('', '[]', 'null')")


def merged_fields(records: DataFrame) -> DataFrame:
    """vuln_id, field, value, state and provenance. The first source by priority, then id, gives the value; different values make it conflicted.

    Components are resolved apart, so several lists of them are no conflict. Provenance lists every source's assertion in order.
    """
    given = assertions(records)
    order = F.struct("prio", "source_id", "source", "value")
    grouped = given.groupBy("vuln_id", "field").agg(F.min_by("value", order).alias("value"), F.countDistinct("value").alias("values"), F.array_sort(F.collect_list(F.struct("prio", "source_id", "source", "url", "value"))).alias("provenance"))
    state = F.when((F.col("values") > 1) & (F.col("field") != "components"), "conflicted").otherwise("present")
    return grouped.select("vuln_id", "field", "value", state.alias("state"), "provenance")


def canonical_records(records: DataFrame) -> DataFrame:
    """One row per identity: status, aliases, refs, sources, fields, field_states, conflicts and revision.

    Rejected if its cve record is, or no record of it is active. The revision digests what the record says, whatever the order or time of its sources.
    """
    r = records.withColumn("vuln_id", identity())
    heads = r.groupBy("vuln_id").agg(
        (F.max((F.col("source") == "cve") & (F.col("status") == "rejected")) | ~F.max(F.col("status") == "active")).alias("rejected"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.expr("cast(array() as array<string>)")))))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("refs", F.expr("cast(array() as array<string>)")))))).alias("refs"),
        F.array_sort(F.collect_set(F.struct("source", "source_id", "status"))).alias("sources"),
    )
    f = merged_fields(records).groupBy("vuln_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "state"))).alias("f"))
    both = heads.join(f, "vuln_id", "left").withColumn("f", F.coalesce("f", F.expr("cast(array() as array<struct<field:string,value:string,state:string>>)")))
    names = F.array_sort(F.array_union(F.array(*map(F.lit, CORE)), F.col("f.field")))
    state = lambda n: F.coalesce(F.get(F.filter("f", lambda x: x["field"] == n), F.lit(0))["state"], F.lit("missing"))
    out = both.select(
        "vuln_id", F.when(F.col("rejected"), "rejected").otherwise("active").alias("status"), "aliases", "refs", "sources",
        F.map_from_entries(F.transform("f", lambda x: F.struct(x["field"], x["value"]))).alias("fields"),
        F.map_from_entries(F.transform(names, lambda n: F.struct(n, state(n)))).alias("field_states"),
        F.transform(F.filter("f", lambda x: x["state"] == "conflicted"), lambda x: x["field"]).alias("conflicts"),
    )
    said = F.to_json(F.struct("vuln_id", "status", "aliases", "refs", "sources", F.map_entries("fields").alias("fields"), F.map_entries("field_states").alias("states")))
    return out.withColumn("revision", F.sha2(said, 256))


def rejects(records: DataFrame) -> DataFrame:
    """Records that cannot be merged and why: unknown source or status, no id, or several CVE names as aliases."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), F.upper), lambda a: a.rlike(r"^CVE-\d{4}-\d{4,}$")))
    kinds = F.array(
        F.when(~F.col("source").isin(*PRIORITY) | F.col("source").isNull(), "unknown_source"), F.when(~F.col("status").isin("active", "rejected") | F.col("status").isNull(), "invalid_status"),
        F.when(F.col("source_id").isNull() | (F.trim("source_id") == ""), "missing_id"), F.when(F.size(names) > 1, "several_identities"),
    )
    return records.select("source", "source_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def improvements(before: DataFrame, after: DataFrame) -> DataFrame:
    """vuln_id, missing_before, filled, new_conflicts and missing_after of canonical records (vuln_id, field_states) after an enrichment."""
    b = before.select("vuln_id", F.col("field_states").alias("s1"))
    both = b.join(after.select("vuln_id", F.col("field_states").alias("s2")), "vuln_id", "left").withColumn("s2", F.coalesce("s2", "s1"))
    core = F.array(*map(F.lit, CORE))
    of = lambda s, n: F.coalesce(F.col(s)[n], F.lit("missing"))
    return both.select(
        "vuln_id", F.filter(core, lambda n: of("s1", n) == "missing").alias("missing_before"), F.filter(core, lambda n: (of("s1", n) == "missing") & (of("s2", n) != "missing")).alias("filled"),
        F.filter(core, lambda n: (of("s1", n) != "conflicted") & (of("s2", n) == "conflicted")).alias("new_conflicts"), F.filter(core, lambda n: of("s2", n) == "missing").alias("missing_after"),
    )


COMPONENT = "vuln_id string, entity_id string, vendor string, name string, basis string, confidence string, purls array<string>, cpes array<string>, versions string, default_status string, sources array<string>, findings array<string>"


def resolve(rows: list[dict]) -> list[dict]:
    """Components of one record, from assertions in order. One joins the first cluster that shares a strong identifier (package URL or CPE
    coordinate) with it, or its vendor and name without contradicting an identifier; contradictions become findings, never merges by name.
    """
    clusters: list[dict] = []
    findings: list[str] = []
    for r in rows:
        strong = {k: set(r[k]) for k in ("purls", "cpes")}
        named = f"name:{r['vendor_token']}:{r['name_token']}" if r["vendor_token"] and r["name_token"] else None
        home = None
        for c in clusters:
            shares = any(strong[k] & c[k] for k in strong)
            alike = named is not None and named == c["named"]
            if not shares and not alike:
                continue
            apart = any(strong[k] and c[k] and not strong[k] & c[k] for k in strong)
            if apart:
                findings.append(f"conflicting_component_identifiers:{r['vendor']}/{r['name']}")
            if shares or not apart:
                home = c
                break
        if home is None:
            home = {"named": named, "purls": set(), "cpes": set(), "rows": []}
            clusters.append(home)
        home["rows"].append(r)
        for k in strong:
            home[k] |= strong[k]
    out = []
    for c in clusters:
        sources = sorted({r["from"] for r in c["rows"]})
        purls, cpes = sorted(c["purls"]), sorted(c["cpes"])
        basis, name, sure = ("purl", purls[0], "high") if purls else ("cpe", cpes[0], "high") if cpes else ("vendor_product", c["named"], "medium") if c["named"] else ("unresolved", "unresolved:" + digest([sources, [[r["vendor"], r["name"]] for r in c["rows"]]]), "low")
        own = [] if sure != "low" else ["unresolved_component_identity"]
        said = sorted({r["default_status"] for r in c["rows"] if r["default_status"] not in (None, "", "unknown")})
        own += ["conflicting_component_status"] if len(said) > 1 else []
        first = lambda k, t: min(((r[t], r[k]) for r in c["rows"] if r[k]), default=("", ""))[1]  # noqa: B023, E731
        rules = list(dict.fromkeys(canonical(v) for r in c["rows"] for v in r["versions"]))
        out.append({"entity_id": "component:" + digest(name)[:24], "vendor": first("vendor", "vendor_token"), "name": first("name", "name_token"), "basis": basis, "confidence": sure, "purls": purls, "cpes": cpes, "versions": f"[{','.join(rules)}]", "default_status": said[0] if len(said) == 1 else "unknown", "sources": sources, "findings": own})
    if out and findings:
        out[0]["findings"] = findings + out[0]["findings"]
    return sorted(out, key=lambda x: x["entity_id"])


def resolved_components(records: DataFrame) -> DataFrame:
    """Components of every identity, with findings for review; the clustering of one identity's assertions is greedy, so it runs in one group, in order of priority, id and place."""
    prio = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in PRIORITY.items()], F.lit(len(PRIORITY)))
    c = records.filter("status = 'active'").select(identity().alias("vuln_id"), prio.alias("prio"), "source", "source_id", F.posexplode("components").alias("place", "c"))
    names = F.coalesce("c.cpes", F.expr("cast(array() as array<string>)"))
    rows = c.select(
        "vuln_id", "prio", "source_id", "place", F.concat_ws(":", "source", "source_id").alias("from"), F.trim(F.coalesce("c.vendor", F.lit(""))).alias("vendor"), F.trim(F.coalesce("c.name", F.lit(""))).alias("name"),
        entity_token(F.col("c.vendor")).alias("vendor_token"), entity_token(F.col("c.name")).alias("name_token"), F.array_compact(F.array(purl_coordinate(F.col("c.purl")))).alias("purls"),
        F.array_distinct(F.array_compact(F.transform(names, cpe_coordinate))).alias("cpes"), F.col("c.versions").alias("versions"), F.col("c.default_status").alias("default_status"),
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["prio", "source_id", "place"])
        found = resolve([{**r, "purls": list(r["purls"]), "cpes": list(r["cpes"]), "versions": json.loads(r["versions"] or "[]")} for r in g.to_dict("records")])
        return pd.DataFrame([{"vuln_id": group.vuln_id.iloc[0], **x} for x in found], columns=[x.split()[0] for x in COMPONENT.split(", ")])

    return rows.groupBy("vuln_id").applyInPandas(run, COMPONENT)


def first_of_each(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in order."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("rn = 1").drop("rn")


def kept_longest(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Of several rows for a key the one with the longest text, the greater text where several are."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(F.length(text), F.col(text))).alias("r")).select(key, "r.*")

