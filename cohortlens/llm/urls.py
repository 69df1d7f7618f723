"""URL filters: rules first, then gradient-boosted trees on lexical features.

Everything is DataFrame code. A url's host and path are cut out by string
functions; the longest rule that fits decides. The rules also label the urls
they fit, and from those labels boosted trees learn what blocked urls look like,
on a bounded sample of distinct urls of each class, where a url weighs as many
rows as it stands for (its rows / the class's sampling fraction): lengths, depth, share of digits, character entropy,
numbers of parameters, hyphens and host labels, whether there is a fragment,
and how often urls of the same host suffix (its last one, two and three labels)
and path ending, and on request of the same first path part, are blocked. A url that is learnt from sees
these shares without its own fifth of the urls. The trees judge the urls that no
rule fits; from which odds on they block is measured on a fifth that a second
fit hasn't seen, for the highest balanced accuracy there.

Nulls and edges: a null url, or one without ``://``, has an empty host and path
and no rule. Without blocked (or without allowed) urls to learn from, the
trees' verdict is the only class there is, and ``allow`` without any. Repeated
rows stay; a column of pages that has the name of a result column gives way to it. Rules are a short list of literals that travel in the plan.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import written


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host/path: it fits the host and all its subdomains where the path starts with the rule's."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)
#: About so many distinct labelled urls of each class are learnt from.
SAMPLE = 20_000
#: Weight of the overall share of blocked urls in a suffix's share.
PRIOR = 10.0
LEXICAL = ["url_length", "host_length", "path_length", "depth", "digit_share", "entropy", "parameters", "hyphens", "host_labels", "fragment"]
#: Parts of a url whose shares of blocked urls are features: the ends of its host and path ...
ENDS = ("suffix_1", "suffix_2", "suffix_3", "ending")
#: ... and, where sections of sites are of one kind, the first part of its path.
SECTIONS = (*ENDS, "section")
FOLDS = 5


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lowered) and ``path``: what follows the first :// up to / ? #, and from there up to ? #."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return (pages.withColumn("host", F.translate(host, string.ascii_uppercase, string.ascii_lowercase))
            .withColumn("path", path))


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
    return host & F.startswith(F.col("path"), F.lit(rule.path))


def with_rule(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits (null where none does)."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):  # the longest ends up outermost
        rule, verdict = F.when(_fits(r), F.lit(r.pattern)).otherwise(rule), F.when(_fits(r), F.lit(r.verdict)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def with_features(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add the lexical features, the places of SECTIONS and the fold (by the url alone)."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    size = F.length(url)
    count = lambda chars: (size - F.length(F.translate(url, chars, ""))).cast("double")
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return pages.withColumns({
        "url_length": size.cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": (F.length("path") - F.length(F.translate(F.col("path"), "/", ""))).cast("double"),
        "digit_share": F.when(size > 0, count(string.digits) / size).otherwise(0.0), "entropy": entropy,
        "parameters": count("?&"), "hyphens": count("-"), "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "fragment": (F.instr(url, "#") > 0).cast("double"), "suffix_1": F.substring_index("host", ".", -1), "suffix_2": F.substring_index("host", ".", -2), "suffix_3": F.substring_index("host", ".", -3),
        "section": F.split_part("path", F.lit("/"), F.lit(2)), "ending": F.regexp_extract("path", r"(/|\.[A-Za-z0-9]{1,8})$", 1),
        "fold": F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")})


def place_counts(labelled: DataFrame, places: Sequence[str] = ENDS) -> tuple[DataFrame, float]:
    """(place, value, blocked, n) of the labelled urls, the two last as arrays by fold, written once, and the overall share."""
    each = labelled.select("fold", "label", F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.col(p).alias("value")) for p in places])).alias("_p"))
    folds = [F.col("fold") == f for f in range(FOLDS)]
    counts = written(each.groupBy("_p.place", "_p.value").agg(
        F.array(*[F.sum(F.when(f, F.col("label")).otherwise(0.0)) for f in folds]).alias("_blocked"),
        F.array(*[F.sum(F.when(f, 1.0).otherwise(0.0)) for f in folds]).alias("_n")), "places")
    blocked, n = labelled.agg(F.sum("label"), F.count("label")).first()
    return counts, float((blocked or 0) / n) if n else 0.0


def with_shares(rows: DataFrame, counts: DataFrame, overall: float, without_own: bool, places: Sequence[str] = ENDS) -> DataFrame:
    """Add every place's share of blocked urls, drawn to the overall share; ``without_own`` leaves the row's own fold out."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x) - (F.element_at(c, F.col("fold") + 1) if without_own else 0.0)
    for p in places:
        own = counts.where(F.col("place") == p).select(F.col("value").alias(p), "_blocked", "_n")
        share = (F.coalesce(total(F.col("_blocked")), F.lit(0.0)) + PRIOR * overall) / (F.coalesce(total(F.col("_n")), F.lit(0.0)) + PRIOR)
        rows = rows.join(own, p, "left").withColumn(f"{p}_share", share).drop("_blocked", "_n")
    return rows


@dataclass(frozen=True)
class Judge:
    """What the trees need to judge rows of ``with_features``; without both classes to learn from, only the constant odds."""

    counts: DataFrame | None
    overall: float
    model: object | None
    cut: float = 0.5
    places: Sequence[str] = ENDS

    def odds(self, rows: DataFrame, out: str = "blocked_odds") -> DataFrame:
        if self.model is None:
            return rows.withColumn(out, F.lit(self.overall))
        vectors = _vectors(self.places).transform(with_shares(rows, self.counts, self.overall, False, self.places))
        return self.model.transform(vectors).withColumn(out, _blocked())


def _vectors(places: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[*LEXICAL, *[f"{p}_share" for p in places]], outputCol="_features")


def _blocked() -> Column:
    return F.element_at(vector_to_array("probability"), 2)


def learn(labelled: DataFrame, sample: int = SAMPLE, seed: int = 11, places: Sequence[str] = ENDS) -> Judge:
    """Trees and cut-off from rows of ``with_features`` with ``label`` 1.0 (blocked) or 0.0."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    if len(counts) < 2:
        return Judge(None, 1.0 if 1.0 in counts else 0.0, None)
    shares, overall = place_counts(labelled, places)
    # all rows of a url are drawn together, as one row with its weight
    part = F.when(F.col("label") == 1, min(1.0, sample / counts[1.0])).otherwise(min(1.0, sample / counts[0.0]))
    drawn = labelled.where(F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1_000_000)) < part * 1_000_000)
    each = drawn.groupBy("url", "label", "fold", *places, *LEXICAL).agg((F.count(F.lit(1)) / F.first(part)).alias("_weight"))
    chosen = written(_vectors(places).transform(with_shares(each, shares, overall, True, places))
                     .select("fold", "_features", "label", "_weight"), "urls")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=10, maxDepth=3, seed=seed)
    fit = lambda rows: trees.fit(rows.select("_features", "label", "_weight").repartition(4, F.hash("_features")))
    model = fit(chosen)
    seen, unseen = chosen.where("fold != 0"), chosen.where("fold = 0")
    if seen.agg(F.countDistinct("label")).first()[0] < 2 or unseen.agg(F.countDistinct("label")).first()[0] < 2:
        return Judge(shares, overall, model, places=places)
    return Judge(shares, overall, model, best_cut(fit(seen).transform(unseen)), places)


def best_cut(judged: DataFrame, steps: int = 100) -> float:
    """The odds, in hundredths, above which blocking has the highest balanced accuracy; ties to the nearest to a half."""
    binned = judged.groupBy(F.floor(_blocked() * steps).alias("bin")).agg(
        F.sum(F.when(F.col("label") == 1, F.col("_weight")).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0.0).otherwise(F.col("_weight"))).alias("neg")).collect()
    pos, neg = sum(r["pos"] for r in binned), sum(r["neg"] for r in binned)
    gain = {c: sum(r["pos"] for r in binned if r["bin"] >= c) / pos + sum(r["neg"] for r in binned if r["bin"] < c) / neg for c in range(1, steps)}
    top = max(gain.values())
    return min((c for c, g in gain.items() if g >= top - 1e-9), key=lambda c: (abs(c - steps / 2), c)) / steps


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url", sample: int = SAMPLE, seed: int = 11,
          places: Sequence[str] = ENDS) -> DataFrame:
    """``pages`` with host, path, rule, verdict and blocked_odds (the trees' probability, null where a rule decides)."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "blocked_odds")]
    named = pages.select(F.col(url_col).cast("string").alias("url"), F.struct(*own).alias("_own"))
    seen = with_features(with_rule(with_parts(named)))
    marked = seen.withColumn("label", F.when(F.col("rule_verdict") == "block", 1.0).when(F.col("rule_verdict") == "allow", 0.0))
    learnt = learn(marked.where("label is not null").drop("_own"), sample, seed, places)
    full = learnt.odds(marked).withColumn("blocked_odds", F.when(F.col("rule").isNull(), F.col("blocked_odds")))
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked_odds") >= learnt.cut, F.lit("block")).otherwise(F.lit("allow")))
    return full.select("_own.*", "host", "path", "rule", verdict.alias("verdict"), "blocked_odds")
