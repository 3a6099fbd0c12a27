"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the script range that is cut into single and paired characters, and what counts as white space.
TOKEN = "[a-z0-9_]+(?:[.:-][a-z0-9_]+)*"
HAN = "[\\x{3400}-\\x{9fff}]+"
WHITE = "[\\s\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"  # what Unicode calls separators of this kind


def tokens(text: Column) -> Column:
    """Lower-cased word tokens, then single characters and neighbouring pairs of each stretch of Han script."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(HAN), F.lit(0))
    single = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, ""), lambda c: c != "")))
    paired = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.concat(words, single, paired)


def normalized(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))


def text_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def split_bucket(family: Column, seed: str) -> Column:
    """train, validation or test by the first 32 bits of sha256(seed:family), 80 : 10 : 10."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), family), 256), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test")


def cves(text: Column) -> Column:
    """Distinct upper-case identifiers in a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)CVE-\d{4}-\d{4,}"), F.lit(0)), F.upper)))


def purl_coordinate(purl: Column) -> Column:
    """Package URL without version, qualifiers and subpath, decoded and lower-cased; null for another form."""
    text = F.trim(purl)
    plain = F.split_part(F.split_part(text, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    decoded = F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    name = F.lower(F.regexp_replace(F.coalesce(decoded, plain), "@[^/]*$", ""))
    return F.when(F.lower(text).startswith("pkg:") & name.contains("/"), name)


# Behaviour classes of code and their patterns over lower-cased text.
BEHAVIOURS = {
    "network": r"\b(socket|connect|requests(?:\.|\b)|urllib|curl|wget|http[s]?://)",
    "process": r"\b(subprocess|popen|execve|system\s*\(|createprocess|runtime\.getruntime)",
    "filesystem": r"\b(open\s*\(|write\s*\(|unlink|remove\s*\(|pathlib|fopen|ofstream)",
    "command_execution": r"\b(eval\s*\(|exec\s*\(|shell\s*=\s*true|cmd\.exe|/bin/sh)",
    "encoding": r"\b(base64|hexlify|fromhex|decode\s*\()",
    "database": r"\b(select|insert|update|delete)\b|\b(execute|query)\s*\(",
    "memory": r"\b(memcpy|malloc|free\s*\(|virtualalloc|mmap\s*\()",
}


def behaviours(code: Column) -> Column:
    """Names of the classes whose pattern the code has, sorted."""
    low = F.lower(code)
    return F.filter(F.array(*[F.when(low.rlike(BEHAVIOURS[k]), F.lit(k)) for k in sorted(BEHAVIOURS)]), lambda x: x.isNotNull())


def yaml_scalar(text: Column, key: str) -> Column:
    """The value of the first line that sets a key, quotes left out; empty if none does."""
    return F.trim(F.regexp_extract(text, rf"(?m)^\s*{key}\s*:\s*['\"]?([^\r\n'\"]+)", 1))


def entity_token(text: Column) -> Column:
    """Letters a to z, digits and Han characters of a name, lower-cased, after compatibility forms of full width are folded."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    plain = "".join(chr(0x21 + i) for i in range(94))
    return F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), wide, plain)), "[^a-z0-9\\x{3400}-\\x{9fff}]+", "")


def cpe_coordinate(cpe: Column) -> Column:
    """Part, vendor and product of a CPE 2.3 name as tokens; null for another form."""
    pattern = "(?i)^cpe:2\\.3:([aho]):([^:]+):([^:]+):"
    parts = [entity_token(F.regexp_extract(F.trim(cpe), pattern, i)) for i in (1, 2, 3)]
    return F.when(F.trim(cpe).rlike(pattern), F.concat_ws(":", F.lit("cpe:2.3"), *parts))


def to_utc(text: Column, zone: str = "+00:00") -> Column:
    """A timestamp from ISO 8601 text; one without an offset is in zone. Text of another form gives null."""
    clean = F.regexp_replace(F.trim(text), "^(\\d{4})[/.](\\d{1,2})[/.](\\d{1,2})", "$1-$2-$3")
    dated = F.when(clean.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}$"), F.concat(clean, F.lit("T00:00:00"))).otherwise(F.regexp_replace(clean, " ", "T"))
    return F.try_to_timestamp(F.when(dated.rlike("(Z|[+-]\\d{2}:?\\d{2})$"), dated).otherwise(F.concat(dated, F.lit(zone))))


def iso(stamp: Column) -> Column:
    """A timestamp as UTC text with milliseconds, in a session whose time zone is UTC."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# Hints of risk and the words that give them.
RISKS = {
    "kernel_requires_separate_pool": ("kernel",),
    "privilege_escalation": ("privilege escalation", "gain privilege"),
    "code_execution_or_memory_corruption": ("execute arbitrary code", "remote code execution", "buffer overflow", "buffer overrun"),
    "availability_impact": ("denial of service",),
}


def risk_hints(text: Column) -> Column:
    """Names of the hints one of whose words a text has, in order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(F.array_contains(F.array(*[low.contains(w) for w in words]), True), F.lit(k)) for k, words in RISKS.items()]), lambda x: x.isNotNull())


def trace_event(line: Column) -> Column:
    """timestamp, type (syscall, signal, exit; null: not understood), name, return_code and raw of a system-call trace's line."""
    line = F.trim(line)
    stamp, body = F.regexp_extract(line, r"^(\d+\.\d+) (.+)$", 1), F.regexp_extract(line, r"^(\d+\.\d+) (.+)$", 2)
    call = r"^([A-Za-z_][A-Za-z0-9_]*)\(.*\)\s+=\s+(.+)$"
    kind = F.when(body.rlike(call), "syscall").when(body.startswith("--- SIG") | body.startswith("+++ killed by"), "signal").when(body.startswith("+++ exited with"), "exit")
    code = F.regexp_extract(F.regexp_extract(body, call, 2), r"^(-?\d+)(?:\s|$)", 1)
    return F.struct(F.nullif(stamp, F.lit("")).alias("timestamp"), kind.alias("type"), F.nullif(F.regexp_extract(body, call, 1), F.lit("")).alias("name"), F.nullif(code, F.lit("")).cast("long").alias("return_code"), body.alias("raw"))


def record_path(identifier: Column) -> Column:
    """year/thousands/identifier of a CVE record; null for another form."""
    name = F.upper(F.trim(identifier))
    number = F.split_part(name, F.lit("-"), F.lit(3))
    return F.when(name.rlike(r"^CVE-\d{4}-\d{4,}$"), F.concat_ws("/", F.split_part(name, F.lit("-"), F.lit(2)), F.concat(F.substr(number, F.lit(1), F.length(number) - 3), F.lit("xxx")), F.concat(name, F.lit(".json"))))
