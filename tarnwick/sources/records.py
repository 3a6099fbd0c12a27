"""Readers of record files, catalogue envelopes and logs."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.text import cves, yaml_scalar

SOURCES = ("cve", "nvd", "avd", "cnnvd")
RECORD = "source string, source_id string, url string, aliases array<string>, status string, source_updated_at string, title string, description string, severity string, weaknesses array<string>, components array<struct<vendor:string,name:string,versions:string,default_status:string,purl:string,cpes:array<string>>>, refs array<string>, attack_preconditions string, poc string, patch string, image_text string, applicability string, extra map<string,string>"
COLUMNS = [x.split(" ")[0] for x in re.split(r", (?=\w+ )", RECORD)]
CVE_NAME = re.compile(r"CVE-\d{4}-\d{4,}")
#: Score versions, the preferred first.
SCORE_ORDER = ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
SKIPPED = ("delta.json", "deltaLog.json")


def read_payloads(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path and payload of every matching file below a folder; delta files stay out and a byte order mark is dropped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("payload"))
    return named.filter(~F.element_at(F.split("path", "/"), -1).isin(*SKIPPED))


def read_records(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Typed records of every .json, .jsonl, .html and .htm file below a folder, or of one such file: a payload per file, line or page."""
    whole = read_payloads(spark, path, "*.json").select("payload")
    lines = read_lines(spark, path, "*.jsonl").select(F.col("value").alias("payload"))
    found = records(whole.unionByName(lines), source)
    pages = read_payloads(spark, path, "*.htm*")
    return found.unionByName(page_records(pages.select(F.col("path").alias("url"), F.col("payload").alias("html")), source)) if source in PAGE_IDS else found


def parsed_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, line and value of lines that hold a JSON object, and path, line and kind of all others."""
    kind = F.when(F.expr("try_parse_json(value)").isNull(), "invalid_json").when(~F.trim("value").startswith("{"), "no_object")
    return lines.filter(kind.isNull()), lines.withColumn("kind", kind).filter("kind is not null").drop("value")


def read_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, line (from 1) and value of every non-empty line; in order of path and line they stand as read, which a log that only grows keeps."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return lines.filter(F.trim("value") != "").select("path", (F.col("line") + 1).alias("line"), "value")


def described(items: list) -> str | None:
    """The distinct texts of descriptions in English, or else in any language, one per line."""
    texts = [x for x in items or [] if isinstance(x, dict) and x.get("value")]
    chosen = [x["value"] for x in texts if str(x.get("lang", "en")).lower().startswith("en")] or [x["value"] for x in texts]
    return "\n".join(dict.fromkeys(chosen)) or None


def number(text: object) -> float:
    """A score version as a number, so that 10.0 is over 4.0; 0 for what is none."""
    try:
        return float(str(text or 0))
    except ValueError:
        return 0.0


def as_json(value: object) -> str | None:
    return None if value in (None, "", [], {}) else json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def component(d: dict, versions: object = None, cpes: object = None) -> dict:
    listed = d.get("cpes") if cpes is None else cpes
    return {"vendor": d.get("vendor"), "name": d.get("product") or d.get("name") or d.get("packageName"), "versions": json.dumps((d.get("versions") if versions is None else versions) or []), "default_status": d.get("defaultStatus") or d.get("default_status"), "purl": d.get("packageURL"), "cpes": [listed] if isinstance(listed, str) else listed or []}


def cve_name(text: object) -> str:
    name = str(text or "").strip().upper()
    if not CVE_NAME.fullmatch(name):
        raise ValueError(f"no CVE name: {text}")
    return name


def cve_record(d: dict) -> dict:
    """A CVE JSON 5 record: the CNA's container first, then the others'; the score of the highest version, and the SSVC content."""
    meta, own = d["cveMetadata"], d.get("containers") or {}
    name = cve_name(meta.get("cveId"))
    parts = [c for c in [own.get("cna"), *(own.get("adp") or [])] if c]
    metrics = [(k, v) for c in parts for m in c.get("metrics") or [] for k, v in m.items() if isinstance(v, dict)]
    best = max((v for k, v in metrics if k.lower().startswith("cvss")), key=lambda v: number(v.get("version")), default={})
    ssvc = next((v.get("content") for k, v in reversed(metrics) if k == "other" and v.get("type") == "ssvc"), None)
    weak = [x["cweId"] for c in parts for p in c.get("problemTypes") or [] for x in p.get("descriptions") or [] if x.get("cweId")]
    extra = {"cvss": as_json(best), "ssvc": as_json(ssvc), "published_at": as_json(meta.get("datePublished")), "updated_at": as_json(meta.get("dateUpdated"))}
    return {
        "source": "cve", "source_id": name, "url": f"https://www.cve.org/CVERecord?id={name}", "aliases": [name], "status": "rejected" if meta.get("state") == "REJECTED" else "active", "source_updated_at": meta.get("dateUpdated"),
        "title": (own.get("cna") or {}).get("title"), "description": described([x for c in parts for x in c.get("descriptions") or []]), "severity": (best.get("baseSeverity") or "").lower() or None,
        "weaknesses": list(dict.fromkeys(weak)), "components": [component(a) for c in parts for a in c.get("affected") or []], "refs": list(dict.fromkeys(r["url"] for c in parts for r in c.get("references") or [] if r.get("url"))), "extra": {k: v for k, v in extra.items() if v},
    }


def vulnerable_leaves(node: object) -> list[dict]:
    """Leaves marked vulnerable anywhere in a configuration tree, in its order."""
    out: list[dict] = []
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            out += [m for m in x.get("cpeMatch") or [] if m.get("vulnerable") and m.get("criteria")]
            stack.extend(x.get(k) for k in ("children", "nodes") if x.get(k))
    return out


def nvd_record(d: dict) -> dict:
    """An NVD 2 record. The configuration tree stays whole as applicability; its vulnerable leaves are components as well, with their version bounds."""
    c = d.get("cve") or d
    name = cve_name(c.get("id"))
    metrics = c.get("metrics") or {}
    score = next((metrics[k][0] for k in SCORE_ORDER if metrics.get(k)), {})
    severity = (score.get("cvssData") or {}).get("baseSeverity") or score.get("baseSeverity")
    parts = []
    for m in vulnerable_leaves(c.get("configurations")):
        at = re.split(r"(?<!\\):", m["criteria"])
        if len(at) >= 6:
            rule = {"version": at[5], "status": "affected", "versionType": "unknown"} | {k: v for k, v in m.items() if k.startswith("version")}
            parts.append(component({"vendor": at[3], "name": at[4]}, [rule], [m["criteria"]]))
    parts += [component(a) for a in c.get("affected") or []]
    weak = [x["value"] for w in c.get("weaknesses") or [] for x in w.get("description") or [] if re.fullmatch(r"CWE-\d+", str(x.get("value", "")))]
    extra = {"cvss": as_json(score.get("cvssData")), "published_at": as_json(c.get("published")), "updated_at": as_json(c.get("lastModified")), "source_identifier": as_json(c.get("sourceIdentifier"))}
    return {
        "source": "nvd", "source_id": name, "url": f"https://nvd.nist.gov/vuln/detail/{name}", "aliases": [name], "status": "rejected" if str(c.get("vulnStatus", "")).lower() == "rejected" else "active", "source_updated_at": c.get("lastModified"),
        "title": None, "description": described(c.get("descriptions")), "severity": severity.lower() if severity else None, "weaknesses": list(dict.fromkeys(weak)), "components": parts,
        "refs": [r["url"] for r in c.get("references") or [] if r.get("url")], "applicability": as_json(c.get("configurations")), "extra": {k: v for k, v in extra.items() if v},
    }


def exchange_record(source: str, d: dict) -> dict:
    """A record of the exchange form; fields beyond the known ones go to extra as JSON."""
    f = d["fields"]
    known = {"title", "description", "severity", "weaknesses", "components", "attack_preconditions", "poc", "patch", "image_text", "applicability"}
    parts = [component({"name": c} if isinstance(c, str) else c) for c in f.get("components") or []]
    own = {k: f.get(k) for k in ("title", "description", "severity", "attack_preconditions", "poc", "patch", "image_text")}
    return {"source": source, "source_id": str(d["source_id"]), "url": d.get("url"), "aliases": d.get("aliases") or [], "status": d.get("status") or "active", "source_updated_at": d.get("source_updated_at"), "weaknesses": f.get("weaknesses") or [], "components": parts, "refs": d.get("references") or [], "applicability": as_json(f.get("applicability")), "extra": {k: as_json(v) for k, v in f.items() if k not in known and as_json(v)}, **own}


def pointed(document: object, pointer: str) -> object:
    """What a JSON pointer (RFC 6901) names; an error where it names nothing."""
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"no JSON pointer: {pointer}")
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(document, list) and part.isdigit() and int(part) < len(document):
            document = document[int(part)]
        elif isinstance(document, dict) and part in document:
            document = document[part]
        else:
            raise ValueError(f"nothing at {pointer}")
    return document


def mapped_record(source: str, payload: dict, mapping: dict, url: str) -> dict:
    """A record whose parts lie where a mapping's JSON pointers say; source_id must be there, and so must every field that the mapping names."""
    get = lambda name, default=None: pointed(payload, mapping[name]) if isinstance(mapping.get(name), str) else default
    many = lambda x: [x] if isinstance(x, str) else list(x)
    fields = {k: pointed(payload, p) for k, p in (mapping.get("fields") or {}).items()}
    d = {"source_id": str(pointed(payload, mapping["source_id"])), "url": str(get("url", url)), "aliases": many(get("aliases", [])), "references": many(get("references", [])), "status": str(get("status", "active")), "source_updated_at": get("source_updated_at"), "fields": fields}
    return exchange_record(source, d)


def mapped_records(payloads: DataFrame, source: str, mapping: dict, url: str = "") -> DataFrame:
    """Typed records of JSON payloads of another form; what the mapping does not fit gives a row with status invalid."""
    start = mapping.get("record_pointer", "")
    return _records(payloads, source, lambda p: [mapped_record(source, x, mapping.get("mapping", mapping), url) for x in _many(pointed(json.loads(p), start))])


def _many(x: object) -> list:
    return x if isinstance(x, list) else [x]


def parse(source: str, payload: str) -> list[dict]:
    """Records of a list, one object, or an object with an envelope of them."""
    d = json.loads(payload)
    items = d if isinstance(d, list) else d["vulnerabilities"] if isinstance(d.get("vulnerabilities"), list) else [d]
    make = {"cve": cve_record, "nvd": nvd_record}.get(source, lambda x: exchange_record(source, x))
    return [make(x) for x in items]


def records(payloads: DataFrame, source: str) -> DataFrame:
    """Typed records of a payload column; payloads that do not parse give a row with status invalid."""
    if source not in SOURCES:
        raise ValueError(f"no such source: {source}")
    return _records(payloads, source, lambda p: parse(source, p))


def _records(payloads: DataFrame, source: str, make: Callable[[str], list[dict]]) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[dict] = []
            for p in part.payload:
                try:
                    out += make(p)
                except (ValueError, KeyError, TypeError, AttributeError, IndexError):
                    out.append({"source": source, "status": "invalid"})
            yield pd.DataFrame([{n: r.get(n) for n in COLUMNS} for r in out], columns=COLUMNS)

    return payloads.select("payload").mapInPandas(run, RECORD)


def identity(aliases: F.Column = None) -> F.Column:  # type: ignore[assignment]
    """The first alias that is a CVE name, else SOURCE:ID."""
    aliases = F.col("aliases") if aliases is None else aliases
    named = F.filter(aliases, lambda a: F.upper(a).rlike(r"^CVE-\d{4}-\d{4,}$"))
    return F.coalesce(F.upper(F.get(named, F.lit(0))), F.concat_ws(":", F.upper("source"), "source_id"))


class _Pairs(HTMLParser):
    """Heading, label and value pairs of definition lists and tables, links, and visible text of a page."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.stack, self.label = url, [], None
        self.title, self.text, self.held, self.pairs, self.links = "", [], [], [], []
        self.head, self.meta = "", {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("dt", "th", "dd", "td", "h1"):
            self.held = []
        own = dict(attrs)
        if tag == "meta" and own.get("content") and (own.get("name") or own.get("property")):
            self.meta[(own.get("name") or own.get("property")).lower()] = own["content"]
        if tag not in ("meta", "link", "br", "img", "hr", "input"):
            self.stack.append(tag)
        link = dict(attrs).get("href")
        if tag == "a" and link:
            self.links.append(urljoin(self.url, link))

    def handle_endtag(self, tag: str) -> None:
        value = " ".join("".join(self.held).split())
        if tag in ("dt", "th"):
            self.label = value
        elif tag in ("dd", "td") and self.label:
            self.pairs.append((self.label.rstrip(":："), value))
            self.label = None
        elif tag == "h1" and not self.title:
            self.title = value
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not {"script", "style"} & set(self.stack):
            if "title" in self.stack:
                self.head += data
                return
            self.text.append(data)
            self.held.append(data)


def page_details(pages: DataFrame) -> DataFrame:
    """page_id, title, pairs, links and words of detail pages (page_id, url, html)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, url, page in zip(part.page_id, part.url, part.html, strict=True):
                p = _Pairs(url or "")
                p.feed(page or "")
                out.append((key, p.title, [f"{a}={b}" for a, b in p.pairs], p.links, len(" ".join(p.text).split())))
            yield pd.DataFrame(out, columns=["page_id", "title", "pairs", "links", "words"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, title string, pairs array<string>, links array<string>, words long")


# Forms of ids on detail pages, marks of pages that ask for a check instead, labels of what they say, and severities.
PAGE_IDS = {"avd": re.compile(r"AVD-\d{4}-\d+", re.I), "cnnvd": re.compile(r"CNNVD-\d{6}-\d+", re.I)}
REFUSED = re.compile(r'"_waf_[^"]+"|\u8bbf\u95ee\u9a8c\u8bc1|\u5b89\u5168\u9a8c\u8bc1')
LABELS = {
    "description": ("漏洞描述", "漏洞详情", "漏洞简介", "description"),
    "severity": ("危害等级", "风险等级", "severity"),
    "product": ("影响产品", "受影响产品", "影响组件", "产品名称", "affected product"),
    "published": ("披露时间", "发布时间", "发布日期", "published"),
    "updated": ("更新时间", "更新日期", "last modified"),
}
PAGE_SEVERITY = {"超危": "critical", "严重": "critical", "高危": "high", "中危": "medium", "低危": "low"}


def page_time(text: str) -> str | None:
    """The first date of a text as ISO 8601; a time without an offset is Chinese time, a date alone is UTC."""
    m = re.search(r"(\d{4}-\d{1,2}-\d{1,2})(?:[T ](\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?)(Z|[+-]\d{2}:?\d{2})?)?", text)
    return m and (f"{m[1]}T{m[2]}{m[3] or '+08:00'}" if m[2] else f"{m[1]}T00:00:00Z")


def page_record(source: str, page: str, url: str) -> dict:
    """The record of one detail page; an error for a page that asks for a check, or names no id, several ids, or several CVE names."""
    if REFUSED.search(page):
        raise ValueError("a page that asks for a check")
    p = _Pairs(url)
    p.feed(page)
    seen = "\n".join(p.text)
    ids = {x.upper() for x in PAGE_IDS[source].findall(seen)}
    names = {x.upper() for x in re.findall(CVE_NAME.pattern, seen, re.I)}
    if len(ids) != 1 or len(names) > 1:
        raise ValueError("a page must name one id, and one CVE name at most")
    labelled = {k.casefold(): v for k, v in p.pairs}
    said = {f: next((v for k, v in labelled.items() if any(x in k for x in labels)), "") for f, labels in LABELS.items()}
    title = p.title or p.meta.get("og:title") or p.head
    text = said["description"] or p.meta.get("description") or p.meta.get("og:description") or ""
    if not title and not text:
        raise ValueError("a page without title and description")
    return {
        "source": source, "source_id": ids.pop(), "url": url, "aliases": sorted(names), "status": "active", "source_updated_at": page_time(said["updated"] or said["published"]), "title": title, "description": text or None,
        "severity": next((v for k, v in PAGE_SEVERITY.items() if k in said["severity"]), None), "weaknesses": list(dict.fromkeys(x.upper() for x in re.findall(r"CWE-\d+", seen, re.I))), "components": [component({"name": said["product"]})] if said["product"] else [],
        "refs": list(dict.fromkeys(x for x in p.links if x.startswith(("http://", "https://")))), "extra": {"published_at": as_json(page_time(said["published"]))} if said["published"] and page_time(said["published"]) else {},
    }


def page_records(pages: DataFrame, source: str) -> DataFrame:
    """Typed records of detail pages (url, html); a page that is none gives a row with status invalid."""
    packed = pages.select(F.to_json(F.struct("url", "html")).alias("payload"))
    return _records(packed, source, lambda p: [page_record(source, (d := json.loads(p)).get("html") or "", d.get("url") or "")])


def catalogue_records(page: str, url: str) -> list[dict]:
    """Records of the rows of a catalogue's table: id, title, and where the row has them, CVE name, weakness and date."""
    plain = lambda x: " ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split())
    out = []
    for row in re.findall(r"<tr\b[^>]*>(.*?)</tr>", page, re.I | re.S):
        found = PAGE_IDS["avd"].search(row)
        cells = [plain(x) for x in re.findall(r"<td\b[^>]*>(.*?)</td>", row, re.I | re.S)]
        if found and len(cells) >= 4:
            name, weak, day = re.search(CVE_NAME.pattern, row, re.I), re.search(r"CWE-\d+", row, re.I), re.search(r"\d{4}-\d{2}-\d{2}", cells[3])
            out.append({"source": "avd", "source_id": found[0].upper(), "url": urljoin(url, f"/detail?id={found[0].upper()}"), "aliases": [name[0].upper()] if name else [], "status": "active", "title": cells[1], "weaknesses": [weak[0].upper()] if weak else [], "components": [], "refs": [url], "extra": {"published_at": as_json(f"{day[0]}T00:00:00+08:00")} if day else {}})
    return out


def catalogue_rows(pages: DataFrame) -> DataFrame:
    """Typed records of catalogue pages (url, html), one per table row with an id."""
    packed = pages.select(F.to_json(F.struct("url", "html")).alias("payload"))
    return _records(packed, "avd", lambda p: catalogue_records((d := json.loads(p)).get("html") or "", d.get("url") or ""))


# Languages by the ending of a file's name.
LANGUAGES = {"c": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "go": "go", "html": "html", "java": "java", "js": "javascript", "json": "json", "md": "markdown", "php": "php", "pl": "perl", "ps1": "powershell", "py": "python", "rb": "ruby", "rs": "rust", "sh": "shell", "xml": "xml", "yaml": "yaml", "yml": "yaml"}


def read_files(spark: SparkSession, path: str, pattern: str, most_bytes: int) -> DataFrame:
    """item (the path below the folder), content and reason (too_large, binary, or null) of files. Bytes that are no UTF-8 are read as Latin-1."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    item = F.substring_index(F.expr("url_decode(replace(path, '+', '%2B'))"), root, -1)
    reason = F.when(F.col("length") > most_bytes, "too_large").when(F.contains(F.hex("content"), F.lit("00")) & (F.locate("\x00", F.decode("content", "ISO-8859-1")) > 0), "binary")
    text = F.regexp_replace(F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1")), "^\ufeff", "")
    return files.select(item.alias("item"), reason.alias("reason"), F.when(reason.isNull(), text).alias("content"))


def _artifacts(rows: DataFrame, source: str, kind: str, relation: str, sure: float) -> DataFrame:
    ending = F.lower(F.substring_index("item", ".", -1))
    language = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ending], F.lit("text"))
    return rows.select(
        F.sha2(F.concat_ws("\x1f", F.lit(source), "source_item_id"), 256).alias("artifact_id"), F.lit(source).alias("source"), "source_item_id", F.lit(kind).alias("artifact_type"), "title", language.alias("language"),
        F.lit("candidate").alias("review_status"), "content", F.sha2("content", 256).alias("content_sha256"), "cve_ids", F.lit(relation).alias("link_relation"), F.lit(sure).alias("link_confidence"), "metadata",
    )


def template_files(spark: SparkSession, path: str, most_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Artifacts of the YAML templates below a folder that name CVEs, and how many files were left out by reason."""
    files = read_files(spark, path, "*.y{a,}ml", most_bytes).withColumn("cve_ids", cves(F.col("content")))
    reason = F.coalesce("reason", F.when(F.size("cve_ids") == 0, "no_cve"))
    value = lambda k: yaml_scalar(F.col("content"), k)
    name = F.coalesce(F.nullif(value("id"), F.lit("")), F.col("item"))
    rows = files.filter(reason.isNull()).select("item", F.col("item").alias("source_item_id"), F.coalesce(F.nullif(value("name"), F.lit("")), name).alias("title"), "content", "cve_ids", F.to_json(F.struct(name.alias("template_id"), value("severity").alias("severity"), value("tags").alias("tags"))).alias("metadata"))
    return _artifacts(rows, "nuclei", "detection_template", "detects", 0.85), files.filter(reason.isNotNull()).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def indexed_files(spark: SparkSession, path: str, index: str = "files_exploits.csv", most_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Artifacts of the files that a CSV index below a folder names with CVEs, and how many of its rows were left out by reason."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path.rstrip('/')}/{index}")
    rows = rows.withColumn("named", F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), "^/+", "")).withColumn("cve_ids", cves(F.concat_ws(" ", "codes", "aliases", "description")))
    files = read_files(spark, path, "*", most_bytes)
    both = rows.join(files, F.col("named") == F.col("item"), "left")
    reason = F.when(F.size("cve_ids") == 0, "no_cve").when(F.col("item").isNull(), "missing_file").otherwise(F.col("reason"))
    key = F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.col("named"))
    kept = both.filter(reason.isNull()).select("item", key.alias("source_item_id"), F.coalesce("description", key).alias("title"), "content", "cve_ids", F.to_json(F.struct("author", "date_published", "type", "platform", "verified", "tags")).alias("metadata"))
    return _artifacts(kept, "exploitdb", "exploit_code", "claims_to_reproduce", 0.9), both.filter(reason.isNotNull()).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def demo_payloads() -> list[tuple[str, str]]:
    """source and payload of a small synthetic corpus: a path traversal that three sources describe, a scripting and an injection fault."""
    traversal = {"cveMetadata": {"cveId": "CVE-2099-1001", "state": "PUBLISHED"}, "containers": {"cna": {
        "title": "Synthetic: an unpacker leaves its folder", "descriptions": [{"lang": "en", "value": "Synthetic example: an unpacker of archives writes files without a check of where their paths lead."}],
        "affected": [{"vendor": "DemoVendor", "product": "demo-archive", "defaultStatus": "unaffected", "versions": [{"version": "1.0.0", "lessThan": "1.2.0", "versionType": "semver", "status": "affected"}]}],
        "problemTypes": [{"descriptions": [{"cweId": "CWE-22"}]}], "metrics": [{"cvssV3_1": {"baseScore": 7.5, "baseSeverity": "HIGH", "version": "3.1"}}], "references": [{"url": "https://example.invalid/demo/archive"}]}}}
    told = [("avd", "AVD-2099-1001", {"patch": "Resolve the path and see that it stays inside the folder.", "attack_preconditions": "An application unpacks archives of strangers."}), ("cnnvd", "CNNVD-209901-1001", {"severity": "medium", "image_text": "Synthetic transcript of a picture: paths must stay inside the folder."})]
    found = [("CVE-2099-1002", "Synthetic example: a page shows input without escaping, so that scripts of others run.", "CWE-79"), ("CVE-2099-1003", "Synthetic example: a query is put together from input without parameters.", "CWE-89")]
    nvd = [{"cve": {"id": k, "vulnStatus": "Analyzed", "descriptions": [{"lang": "en", "value": t}], "weaknesses": [{"description": [{"value": w}]}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseSeverity": "HIGH", "baseScore": 7.5, "version": "3.1"}}]}}} for k, t, w in found]
    return [("cve", json.dumps(traversal)), *((s, json.dumps({"source_id": i, "aliases": ["CVE-2099-1001"], "url": f"https://example.invalid/{s}/{i}", "fields": f})) for s, i, f in told), *(("nvd", json.dumps(x)) for x in nvd)]


def demo_records(spark: SparkSession) -> DataFrame:
    """Typed records of demo_payloads."""
    rows = [{n: r.get(n) for n in COLUMNS} for s, p in demo_payloads() for r in parse(s, p)]
    return spark.createDataFrame([tuple(r[n] for n in COLUMNS) for r in rows], RECORD)
