"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256). The ledger is a
folder of written batches with a row for each scanned blob: the rule versions
it was scanned with and what they found. A scan looks only at pairs of blob and
rule version that the ledger hasn't, reads one copy of each such blob, adds a
batch, and joins the findings back to every row that holds the blob.

Nulls and edges: a null text is the empty blob; an empty ledger folder is a
ledger without rows; repeated rows share their blob's findings and all stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import own_names
from cohortlens.session import fresh_path


@dataclass(frozen=True)
class Rule:
    """Matches are the pattern's leftmost non-overlapping ones whose group has at least ``least`` characters.

    A text can only match where it holds one of ``hints`` (all in lower case; the text is lowered too).
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(words: str) -> str:
    """The pattern with each ASCII letter in either case (and no letter beyond ASCII)."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: A private key: its header, then header fields, base64 lines of 16 or more characters (or runs of 40 or more), a shorter last line
#: that ends with =, before the END line or at the text's end, and the END line; header and END line alone where something else stands between.
_BASE64, _GAP = "[A-Za-z0-9+/]", r"(?:\s|\\[nrt])"
PRIVATE_KEY = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
               r"(?:\s*\n(?:Proc-Type|DEK-Info):[^\n]*)*"
               rf"(?:(?:(?:\s*\n[ \t]*|(?:\\[nrt])+){_BASE64}{{16,}}={{0,2}}(?=[ \t\r]*(?:\n|\Z|\\[nrt]|-----END))|{_GAP}*{_BASE64}{{40,}}={{0,2}})+"
               rf"(?:{_GAP}+{_BASE64}{{1,15}}(?:={{1,2}}(?![A-Za-z0-9+/=])|(?=\s*\Z|{_GAP}*-----END [A-Z ]*PRIVATE KEY)))?)?"
               rf"(?:{_GAP}*-----END [A-Z ]*PRIVATE KEY-----)?"
               r"|-----END [A-Z ]*PRIVATE KEY-----")
RULES = (
    Rule("assign", 1, "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6, hints=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, "AKIA[A-Z0-9]+", least=20, hints=("akia",)),
    Rule("hex", 1, "[0-9a-f]+", least=24),
    Rule("private_key", 3, PRIVATE_KEY, hints=("private key-----",)),
    Rule("web_token", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyj",)),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start: long, order: int, end: long, kind: string>>"


def find(text: str, rules: Sequence[Rule], order: dict[str, int]) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, kind) of every match, by start and kind; code points, end exclusive."""
    low, out = text.lower(), []
    for r in rules:
        if r.hints and not any(h in low for h in r.hints):
            continue
        # a run of one class that is long enough is found at once: shorter runs never hold a long one
        pattern = re.sub(r"\+$", "{%d,}" % r.least, r.pattern) if r.group == 0 and re.fullmatch(r"\[[^]]+\]\+", r.pattern) else r.pattern
        out += [(m.start(), order[r.kind], m.end(), r.kind) for m in re.finditer(pattern, text) if m.end(r.group) - m.start(r.group) >= r.least]
    return sorted(out)


def _scanner(rules: Sequence[Rule]):
    by_key, order = {r.key: r for r in rules}, {r.kind: i for i, r in enumerate(rules)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find(t, [by_key[k] for k in todo], order) for t, todo in zip(b["_body"], b["_todo"], strict=True)]
            yield pd.DataFrame({"blob": b["blob"], "scanned": b["_todo"],
                                "spans": [[dict(zip(("start", "order", "end", "kind"), s, strict=True)) for s in f] for f in found]})

    return run


class BlobLedger:
    """The ledger in folder ``path`` (a new one in the shared folder, by default)."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: Sequence[Rule] = RULES):
        self.spark, self.path, self.rules = spark, path or fresh_path(spark, "blob-ledger"), tuple(rules)

    def rows(self) -> DataFrame | None:
        """All batches so far: blob, scanned (rule keys), spans; None before the first."""
        try:
            return self.spark.read.option("recursiveFileLookup", "true").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def update(self, docs: DataFrame, text_col: str = "text") -> None:
        """Scan what the ledger hasn't of the texts in ``docs``, and add it as a batch."""
        body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        blobs = docs.select(F.sha2(body, 256).alias("blob"), body.alias("_body")).dropDuplicates(["blob"])
        wanted = F.array(*[F.lit(r.key) for r in self.rules])
        known = self.rows()
        if known is None:
            todo = blobs.withColumn("_todo", wanted)
        else:
            seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("_seen"))
            todo = (blobs.join(seen, "blob", "left").withColumn("_todo", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))))
                    .where(F.size("_todo") > 0).drop("_seen"))
        found = todo.mapInPandas(_scanner(self.rules), f"blob string, scanned array<string>, spans {SPANS}")
        found.write.parquet(f"{self.path}/{fresh_path(self.spark, 'batch').rsplit('/', 1)[1]}")

    def findings(self) -> DataFrame:
        """(blob, spans by start and kind) of the blobs in which the present rules found something."""
        known = self.rows()
        now = F.array(*[F.lit(r.key) for r in self.rules])
        one = known.where(F.size("spans") > 0).select("blob", "scanned", F.explode("spans").alias("s"))
        # a span counts if the rule version that found it is a present one
        valid = F.exists(F.array_intersect("scanned", now), lambda k: F.substring_index(k, "@", 1) == F.col("s.kind"))
        return one.where(valid).groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))

    def scan(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with the column ``spans``: what the rules find in each row's whole text."""
        self.update(docs, text_col)
        body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        found = self.findings().select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
        return (docs.withColumn("_own", F.sha2(body, 256)).join(found, F.col("_own") == F.col("_blob"), "left")
                .select(*[F.col(c) for c in docs.columns if c != "spans"], F.coalesce("_spans", F.array().cast(SPANS)).alias("spans")))


def written_spans(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end of the spans (of ``kinds``), comma-joined."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256 (of the base spans) and spans (all, joined)."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    found = ledger.scan(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("_id").alias(id_col), *[count(k) for k in BASE],
                        F.sha2(written_spans(F.col("spans"), BASE), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """``text`` with the spans (by start) replaced; overlapping ones become one mask."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


@own_names
def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", ledger: BlobLedger | None = None) -> DataFrame:
    """``docs``, all columns and rows, with every span of a secret in the text replaced by ``mask``.

    Overlapping spans become one mask. Texts without secrets are left as they are (null stays null) and aren't sent to Python;
    a text with secrets is written in one pass over its spans. Other columns may have any names.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)

    @F.pandas_udf("string")
    def write(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, list(zip(a, b, strict=True)), mask) for t, a, b in zip(texts, starts, ends, strict=True)])

    found, hit = ledger.scan(docs, text_col), F.size("spans") > 0
    text = F.col(text_col).cast("string")
    new = write(F.when(hit, text), F.col("spans.start"), F.col("spans.end"))
    return found.withColumn(text_col, F.when(hit, new).otherwise(text)).drop("spans")
