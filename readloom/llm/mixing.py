"""Operator 9: mixing sources to target weights (DataFrame functions only).

1. A naive Bayes classifier learns domains from a labelled table: word counts
   by domain of about ``SAMPLE`` labelled documents each, at most, over the
   ``VOCABULARY`` most frequent words of that sample. The model is a table of
   that many rows at most, so it is broadcast.
2. Every document gets a soft membership: the posterior of each domain, from
   all its words, with the evidence held to ``EVIDENCE`` words' worth so that
   long texts stay soft.
3. Rates r >= 0, one a document, are fitted so that the expected tokens of each
   domain, sum of r * tokens * posterior, meet the targets: projected gradient
   descent on the squared relative errors. A step needs one aggregate of as many
   sums as there are domains; the rates themselves never leave the executors.
   Every ``KEPT`` steps they become a table's column, so that no step's plan
   holds more than as many others.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

SAMPLE, VOCABULARY, EVIDENCE = 1500, 4096, 12.0
STEPS, CLOSE = 40, 1e-5
KEPT = 4
DOMAINS = 1000  # a column of posteriors each; more raise
HEADROOM = 1.02  # of the default total, so that documents of soft membership don't fall below one copy
BLANKS = r"[\x20\x09-\x0D]+"
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")


def fit_domains(documents: DataFrame, labelled: DataFrame, scratch: Scratch) -> tuple[list[str], list[float], DataFrame]:
    """Domains in order, log priors and the model (word, l0, l1, ...) of ``labelled`` (doc_id, domain) and the texts of ``documents``. Runs at once.

    Rows without id, text or domain teach nothing; priors count all labels. More
    than ``DOMAINS`` domains raise. The sample is
    taken from ids by a hash, about ``SAMPLE`` a domain, so it is broadcast and
    no text is shuffled.
    """
    usable = labelled.where("doc_id is not null and domain is not null").select("doc_id", "domain").distinct()
    sizes = usable.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(DOMAINS + 1).collect()
    if len(sizes) > DOMAINS:
        raise ValueError(f"labels name more than {DOMAINS} domains")
    domains = sorted(x["domain"] for x in sizes)
    total = sum(x["count"] for x in sizes) or 1
    priors = {x["domain"]: x["count"] / total for x in sizes}
    share = F.coalesce(*[F.when(F.col("domain") == x["domain"], F.lit(SAMPLE / x["count"])) for x in sizes], F.lit(0.0))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * float(1 << 40))
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", F.explode(_words(F.col("text"))).alias("word"))
    counts = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{k}") for k, d in enumerate(domains)]
    model = rows.groupBy("word").agg(F.count("*").alias("n"), *counts).orderBy(F.desc("n"), "word").limit(VOCABULARY)
    model = scratch.table(model, "counts")
    sums = model.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(len(domains))]).first() if domains else ()
    logs = [F.log((F.col(f"c{k}") + 0.5) / F.lit(sums[k] + 0.5 * VOCABULARY)).alias(f"l{k}") for k in range(len(domains))]
    priors = [float(priors[d]) for d in domains]
    return domains, priors, scratch.table(model.select("word", *logs), "model")


def memberships(documents: DataFrame, domains: list[str], priors: list[float], model: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), tokens (words) and posteriors p0, p1, ... of every row; a text without known words has the priors."""
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), _words(F.coalesce("text", F.lit(""))).alias("ws"))
    each = keyed.select("doc_id", "h", "row", F.explode_outer("ws").alias("word")).join(F.broadcast(model), "word", "left")
    sums = [F.coalesce(F.sum(f"l{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(domains))]
    known = F.count("l0") if domains else F.lit(0)
    seen = each.groupBy("row", "doc_id", "h").agg(F.count("word").alias("tokens"), known.alias("known"), *sums)
    scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.lit(1), F.col("known")))
    logits = [F.log(F.lit(max(p, 1e-9))) + F.col(f"s{k}") * scale for k, p in enumerate(priors)]
    seen = seen.withColumns({f"z{k}": z for k, z in enumerate(logits)})
    top = F.greatest(*[F.col(f"z{k}") for k in range(len(domains))]) if len(domains) > 1 else F.lit(0.0)
    seen = seen.withColumn("top", top).withColumns({f"e{k}": F.exp(F.col(f"z{k}") - F.col("top")) for k in range(len(domains))})
    whole = sum((F.col(f"e{k}") for k in range(len(domains))), F.lit(0.0))
    return seen.withColumn("whole", whole).select("doc_id", "h", "tokens", *[(F.col(f"e{k}") / F.col("whole")).alias(f"p{k}") for k in range(len(domains))])


def goal_tokens(domains: list[str], present: list[float], targets: Mapping[str, float], total: float | None) -> list[float]:
    """Tokens wanted of each domain. Without ``total``: the least total at which no listed domain shrinks, and a little more. A domain that isn't listed keeps its tokens."""
    weight = {d: float(targets[d]) for d in domains if targets.get(d, 0) > 0}
    scale = sum(weight.values())
    shares = {d: w / scale for d, w in weight.items()}
    if total is None:
        total = HEADROOM * max((n / shares[d] for d, n in zip(domains, present) if d in shares), default=0.0)
    return [total * shares[d] if d in shares else (0.0 if d in targets else n) for d, n in zip(domains, present)]


def fit_rates(members: DataFrame, domains: list[str], targets: Mapping[str, float], scratch: Scratch, total: float | None = None) -> tuple[DataFrame, list[float]]:
    """``members`` with their rate, and the relative error left in each domain. Runs one aggregate a step."""

    def sums(rows: DataFrame) -> list[float]:
        cells = [F.coalesce(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p{k}")), F.lit(0.0)) for k in range(len(domains))]
        return [float(x) for x in rows.agg(*cells).first()]

    rated = members.withColumn("rate", F.lit(1.0))
    if not domains:
        return rated, []
    present = sums(rated)
    goal = goal_tokens(domains, present, targets, total)
    size = [max(g, n, 1.0) for g, n in zip(goal, present)]
    now = present
    for step in range(STEPS):
        errors = [(s - g) / z for s, g, z in zip(now, goal, size)]
        if max(map(abs, errors)) < CLOSE:
            break
        # each error over the domain's own tokens: the largest curvature is 1, and a small domain closes as fast as a large one
        slope = sum((F.col(f"p{k}") * F.lit(e * z / n) for k, (e, z, n) in enumerate(zip(errors, size, present)) if n > 0), F.lit(0.0))
        rated = rated.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - slope))
        if step % KEPT == KEPT - 1:
            rated = scratch.table(rated, f"rated-{step}")
            scratch.drop(f"rated-{step - KEPT}")
        now = sums(rated)
    return rated, [(s - g) / z for s, g, z in zip(now, goal, size)]


def mix(documents: DataFrame, labelled: DataFrame, targets: Mapping[str, float], total: float | None = None, seed: int = 0) -> DataFrame:
    """Per row: doc_id, h, tokens, domain (of the greatest posterior), posterior, rate, copies.

    ``labelled`` has doc_id, domain. Copies are the whole part of the
    rate, and one more for a share of documents as large as the rest, decided by
    a hash of id and text. Null and empty texts have no tokens and the prior's
    posteriors. Without any usable label all rates are 1. Repeated rows have
    equal rates; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    domains, priors, model = fit_domains(documents, labelled, scratch)
    members = scratch.table(memberships(documents, domains, priors, model), "members")
    members, errors = fit_rates(members, domains, targets, scratch, total)
    if missed := {d: e for d, e in zip(domains, errors) if abs(e) >= CLOSE}:
        warnings.warn(f"targets not met; relative error left by domain: {missed}", RuntimeWarning, stacklevel=2)
    draw = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    best = F.greatest(*[F.col(f"p{k}") for k in range(len(domains))]) if len(domains) > 1 else F.lit(1.0)
    domain = F.coalesce(*[F.when(F.col(f"p{k}") == F.col("posterior"), F.lit(d)) for k, d in enumerate(domains)], F.lit(domains[0] if domains else None).cast("string"))
    out = members.withColumn("posterior", best).withColumns({"domain": domain, "copies": (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long"))})
    return out.select("doc_id", "h", "tokens", "domain", "posterior", "rate", "copies")


def resample(documents: DataFrame, rates: DataFrame) -> DataFrame:
    """``documents`` with every row as often as its copies say; rows equal in id and text have equal copies, and a row without rates has none."""
    once = rates.select("doc_id", "h", "copies").dropDuplicates(["doc_id", "h"]).where("copies > 0")
    rows = documents.select(F.struct("*").alias("given"), F.col("doc_id").cast("long").alias("of"), F.xxhash64("text").alias("key"))
    met = rows.join(once, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("h")))
    return met.select("given", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("given.*")


def labelled_documents(documents: DataFrame, labels: DataFrame, domain: str = "lang") -> DataFrame:
    """The labelled table of the queries: doc_id and domain of documents that ``labels`` lists, with one of their columns (language, source) as domain."""
    listed = labels.select("doc_id").where("doc_id is not null").distinct()
    return documents.select("doc_id", F.col(domain).cast("string").alias("domain")).join(listed, "doc_id", "left_semi")


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mix(documents, labelled_documents(documents, labels), TARGETS).drop("h")
