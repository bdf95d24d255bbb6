"""Secret scans over an incremental blob ledger.

Every historical version of a text is addressed by its content (SHA-256), so a version is a *blob* however many
paths hold it. The ledger lists the (blob, rule, rule version) triples that have been scanned, with or without a
finding. A scan looks only at triples the ledger lacks: a new blob meets all rules, a known blob only the rules
whose version changed. Findings are kept by blob and joined back to every path that holds it.

A Store keeps the ledger and the findings as Parquet in a shared folder: each scan is written once, with what it settled and
what it found in the same rows, and a scan that is lost midway leaves nothing behind that counts.

A match holds one of its rule's literals, so a text without any literal is settled without being moved: only its blob id is
shuffled, and the few texts that hold one are scanned once per blob.

redact() replaces the places of the secrets in a single pass over the rows; redact_scanned() does the same by a store's ledger, so that
a blob is scanned once. Places that overlap are one, named for the longest.

Defined cases: a null text is no version and is skipped; an empty text is a blob without findings; a null path id
is carried as null; repeated rows are paths of their own, so a repeated row repeats its findings; an empty table
gives empty results; other columns of the table are ignored and can have any name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.llm.common import fresh
from cumulo.session import cut, shared_dir


@dataclass(frozen=True)
class Rule:
    """pattern: its group 1 is the secret, up to its own end; the syntax is what Java, Python and RE2 share. literals: a match holds one of them."""

    name: str
    version: int
    pattern: str
    literals: tuple[str, ...]


_WORDS = ("token", "Token", "TOKEN", "secret", "Secret", "SECRET", "password", "Password", "PASSWORD", "api_key", "API_KEY", "apikey", "apiKey")

RULES = (
    Rule("assigned_credential", 2, r"""(?:^|[^A-Za-z0-9])(?:""" + "|".join(_WORDS) + r""")["']?[ \t]*[=:][ \t]*["']([^"'\s]{12,})["']""", _WORDS),
    Rule("aws_access_key", 1, r"(?:^|[^A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})", ("AKIA", "ASIA")),
    Rule("git_host_token", 1, r"((?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,})", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 2, r"(xox[abprs]-[A-Za-z0-9-]{10,})", ("xox",)),
    Rule("maps_api_key", 1, r"(AIza[0-9A-Za-z_-]{35,})", ("AIza",)),
    Rule("payment_key", 2, r"(?:^|[^A-Za-z0-9])([sr]k_(?:live|test)_[A-Za-z0-9]{16,})", ("_live_", "_test_")),
    Rule("web_token", 1, r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", ("eyJ",)),
    Rule("private_key", 2, r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----(?:(?s:.*?)-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----|(?s:.*)))", ("PRIVATE KEY",)),
    Rule("uri_password", 2, r"[a-z]://[^\s:/@]*:([^\s:/@]+)@", ("://",)),
)
#: The rules as they were before their upper bounds went; a ledger of that time has these versions.
EARLIER = tuple(Rule(r.name, 1, r.pattern, r.literals) for r in RULES)


def _holds(text: str, rules: tuple[Rule, ...]) -> Column:
    """Whether the text holds a literal of any of the rules."""
    any_literal = F.lit(False)
    for literal in dict.fromkeys(x for r in rules for x in r.literals):
        any_literal = any_literal | F.contains(F.col(text), F.lit(literal))
    return any_literal


def _matches(text: str, rule: Rule) -> Column:
    """The rule's secrets in a text. The literals are looked for first, which costs far less than the pattern."""
    none = F.array().cast("array<string>")
    return F.when(_holds(text, (rule,)), F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(1))).otherwise(none)


def blob_id(text: str) -> Column:
    return F.sha2(F.encode(F.col(text), "UTF-8"), 256)


def paths(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob): which content each path holds."""
    return docs.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), blob_id(text).alias("blob"))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(blob, content, todo): each distinct blob once, with the numbers of the rules it hasn't met in their version.

    content is null where the text holds no rule's literal, so that nothing but the id of such a blob moves.
    """
    content = F.when(_holds(text, rules), F.col(text))
    blobs = docs.where(F.col(text).isNotNull()).select(blob_id(text).alias("blob"), content.alias("content")).groupBy("blob").agg(F.max("content").alias("content"))
    everything = F.array(*[F.lit(i) for i in range(len(rules))]).cast("array<int>")
    if ledger is None:
        return blobs.withColumn("todo", everything)
    number = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        number = F.when((F.col("rule") == r.name) & (F.col("rule_version") == r.version), F.lit(i)).otherwise(number)
    met = ledger.select("blob", number.alias("n")).where("n IS NOT NULL").groupBy("blob").agg(F.collect_set("n").alias("met"))
    left = F.array_except(everything, F.coalesce(F.col("met"), F.array().cast("array<int>")))
    return blobs.join(met, "blob", "left").select("blob", "content", left.alias("todo")).where(F.size("todo") > 0)


def scanned(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo, hits) of the blobs from unseen(): todo has the rules settled by this scan, (rule, rule_version); hits what they found."""
    none = F.array().cast("array<string>")
    hits = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), F.when(F.col("content").isNotNull() & F.array_contains("todo", F.lit(i)), _matches("content", r)).otherwise(none).alias("secrets"))
        for i, r in enumerate(rules)
    ]
    names = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    return blobs.select("blob", F.transform("todo", lambda n: F.element_at(names, n + 1)).alias("todo"), F.filter(F.array(*hits), lambda h: F.size(h["secrets"]) > 0).alias("hits"))


def findings(scans: DataFrame) -> DataFrame:
    """(blob, rule, rule_version, match_no, secret) of scanned()."""
    by_rule = scans.select("blob", F.explode("hits").alias("h"))
    return by_rule.select("blob", "h.rule", "h.rule_version", F.posexplode("h.secrets").alias("at", "secret")).select("blob", "rule", "rule_version", (F.col("at") + 1).alias("match_no"), "secret")


def ledger_entries(scans: DataFrame) -> DataFrame:
    """(blob, rule, rule_version) that scanned() settled."""
    return scans.select("blob", F.explode("todo").alias("r")).select("blob", "r.rule", "r.rule_version")


def _current(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of rule versions that are still in force."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.name) & (F.col("rule_version") == r.version))
    return found.where(current)


class Store:
    """Ledger and findings in a folder that all executors share; each scan adds files that are complete or not there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def scans(self) -> DataFrame | None:
        """All scans so far, (blob, todo, hits)."""
        try:
            return self.spark.read.parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def settle(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
        """Scans what the ledger lacks, writes it, and returns the findings by blob of all scans under these rules."""
        before = self.scans()
        blobs = unseen(docs, None if before is None else ledger_entries(before), rules, text)
        scanned(blobs, rules).write.mode("append").parquet(self.folder)
        return _current(findings(self.scans()), rules)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
        """settle(), and the findings of all paths of docs under these rules."""
        return paths(docs, path, text).join(self.settle(docs, rules, text), "blob")


def scan_incremental(
    docs: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings by path, new findings by blob, new ledger entries), for callers that keep the ledger themselves; the scan itself runs once.

    known: the findings by blob of earlier scans. Those of a rule version no longer among the rules don't count.
    """
    scans = cut(scanned(unseen(docs, ledger, rules, text), rules))
    new = findings(scans)
    by_blob = new if known is None else _current(known, rules).select(*new.columns).unionByName(new)
    return paths(docs, path, text).join(by_blob, "blob"), new, ledger_entries(scans)


def _digests(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").alias("doc_id"), "blob", "rule", "rule_version", "match_no", F.sha2(F.col("secret"), 256).alias("secret_sha256"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of a first scan by path, with the secret's digest in the secret's place."""
    return _digests(scan_incremental(docs, rules=rules)[0])


def report_in_two_scans(docs: DataFrame, first: Column) -> DataFrame:
    """report() of the whole table by two scans of one ledger: the versions of the first crawl under the EARLIER rules, then the table as
    it is now under RULES. The second scan meets new blobs with all rules, and known ones with the rules whose version rose."""
    store = Store(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/secret-ledger-{uuid.uuid4().hex}")
    store.scan(docs.where(first), EARLIER)
    return _digests(store.scan(docs))


# --- redaction --------------------------------------------------------------------------------------------------------


def places(text: str, compiled: list[tuple[str, re.Pattern]]) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the secrets, in order; places that overlap are one, named for the longest (of equal ones the first rule)."""
    found = sorted((*m.span(1), -i, name) for i, (name, p) in enumerate(compiled) for m in p.finditer(text))
    out: list[tuple[int, int, str, int]] = []
    for start, end, _, name in sorted(found, key=lambda x: (x[0], -x[1], -x[2])):
        if out and start < out[-1][1]:
            s, e, other, longest = out[-1]
            out[-1] = (s, max(e, end), name if end - start > longest else other, max(longest, end - start))
        else:
            out.append((start, end, name, end - start))
    return [x[:3] for x in out]


def redacted(text: str, compiled: list[tuple[str, re.Pattern]]) -> str:
    parts, at = [], 0
    for start, end, name in places(text, compiled):
        parts += [text[at:start], f"[SECRET:{name}]"]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with each secret's place replaced by [SECRET:rule]; all rows and columns stay, and the length column follows a text that changes.

    Only texts that hold a literal go through Python; nothing is joined or shuffled.
    """
    patterns = [(r.name, r.pattern) for r in rules]

    @F.pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(name, re.compile(p, re.ASCII)) for name, p in patterns]
        for texts in batches:
            yield pd.Series([None if t is None else redacted(t, compiled) for t in texts], dtype=object)

    return _rewritten(docs, replaced(F.when(_holds(text, rules), F.col(text))), text, length)


def redact_scanned(docs: DataFrame, store: Store, rules: tuple[Rule, ...] = RULES, text: str = "text", length: str = "n_chars") -> DataFrame:
    """redact() by the store's ledger: only what the ledger lacks is scanned, and a text meets only the rules that found something in its blob.

    The scan is written at once. Rows whose text holds a literal are joined with their blob's findings; the others pass and never move.
    """
    patterns = [(r.name, r.pattern) for r in rules]

    @F.pandas_udf("string")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        compiled = [(name, re.compile(p, re.ASCII)) for name, p in patterns]
        for texts, found in batches:
            yield pd.Series([None if t is None else redacted(t, [c for c in compiled if c[0] in names]) for t, names in zip(texts, found)], dtype=object)

    blob, found = fresh(docs, "cumulo_blob"), fresh(docs, "cumulo_found")
    by_blob = store.settle(docs, rules, text).groupBy(F.col("blob").alias(blob)).agg(F.collect_set("rule").alias(found))
    holds = F.coalesce(_holds(text, rules), F.lit(False))
    joined = docs.where(holds).withColumn(blob, blob_id(text)).join(by_blob, blob, "left")
    clean = _rewritten(joined, replaced(F.when(F.col(found).isNotNull(), F.col(text)), F.col(found)), text, length)
    return clean.select(*docs.columns).union(docs.where(~holds))


def _rewritten(docs: DataFrame, replaced: Column, text: str, length: str) -> DataFrame:
    """docs with the replaced text where that isn't null, and with its length where it differs."""
    new = fresh(docs, "cumulo_redacted")
    out = docs.withColumn(new, replaced)
    changed = F.col(new).isNotNull() & (F.col(new) != F.col(text))
    if length in docs.columns:
        out = out.withColumn(length, F.when(changed, F.length(new).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.withColumn(text, F.coalesce(new, text)).select(*docs.columns)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for r in rules:
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, sha256(text) AS blob, '{r.name}' AS rule, CAST({r.version} AS INTEGER) AS rule_version, "
            f"CAST(UNNEST(generate_series(1, len(m))) AS INTEGER) AS match_no, sha256(UNNEST(m)) AS secret_sha256 "
            f"FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}', 1) AS m FROM documents WHERE text IS NOT NULL) WHERE len(m) > 0"
        )
    return "\nUNION ALL\n".join(parts)
