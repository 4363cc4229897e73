"""Identity resolution: blocking join on shared signals, explainable scores, a decision per record.

Signals are rows (subject, signal_type, value).  Candidates come from one equi-join on
(signal_type, value); types that do not block never enter it.  The cap on candidates goes by ascending
identity before scoring, so it can drop the best match: that is the contract.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions import text as X
from dossier.functions.skew import HOT, salted_join
from dossier.operators.rules import ConfigurationError


@dataclass(frozen=True)
class IdentityProfile:
    auto_merge: float = 0.90
    review: float = 0.55
    penalty: float = 0.35
    independent: int = 2
    most_candidates: int = 25
    signals: dict = field(default_factory=lambda: dict(R.SIGNALS))

    def validate(self) -> None:
        if not 0 <= self.review <= self.auto_merge <= 1:
            raise ConfigurationError("thresholds must be ordered within 0 and 1")
        if self.penalty < 0 or self.independent < 1 or self.most_candidates < 1:
            raise ConfigurationError("penalty, independent signals or candidates out of range")
        if any(not 0 <= weight <= 1 for _, weight, _, _ in self.signals.values()):
            raise ConfigurationError("weights must lie within 0 and 1")


def _or(*columns: Column) -> Column:
    """The first value that is not null or empty (blanks count)."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def _columns(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) if n in df.columns else F.lit(None).cast("string") for n in names]


def _long(df: DataFrame, ref: str, entries: list[tuple[str, Column, tuple[str, ...]]]) -> DataFrame:
    structs = [F.struct(F.lit(k).alias("position"), F.lit(t).alias("signal_type"), F.lower(X.strip(c)).alias("value"), F.array(*[F.lit(x) for x in s]).alias("source_fields")) for k, (t, c, s) in enumerate(entries)]
    tiers = {t: R.SIGNALS[t][0] for t, _, _ in entries}
    out = df.select(F.col(ref).alias("ref"), F.explode(F.array(*structs)).alias("x")).select("ref", "x.position", "x.signal_type", "x.value", "x.source_fields")
    return out.where("value is not null and value <> ''").withColumn("tier", X.lookup(F.col("signal_type"), tiers))


def person_signals(df: DataFrame, ref: str) -> DataFrame:
    first, last, title, pe, e, ce, pp, dp, p = _columns(df, "first_name", "last_name", "title", "primary_email", "email", "company_email", "primary_phone", "direct_phone", "phone")
    name = F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))
    return _long(df, ref, [("email_exact", _or(pe, e, ce), ("primary_email",)), ("full_name", name, ("first_name", "last_name")), ("phone", _or(pp, dp, p), ("primary_phone",)), ("title", title, ("title",))])


def company_signals(df: DataFrame, ref: str) -> DataFrame:
    duns, norm, name, pe, ce, city = _columns(df, "duns_number", "company_name_normalized", "company_name", "primary_email", "company_email", "city")
    company = _or(norm, name)
    domain = F.regexp_replace(F.lower(F.regexp_extract(_or(pe, ce), r"@([\w.-]+\.\w+)", 1)), r"^www\.", "")
    return _long(df, ref, [("duns_number", duns, ("duns_number",)), ("company_domain_and_name", F.when(domain != "", F.concat(domain, F.lit("|"), company)), ("company_name", "primary_email")), ("company_name_city", F.when(city != "", F.concat(company, F.lit("|"), city)), ("company_name", "city"))])


def stored_signals(executives: DataFrame) -> DataFrame:
    """Signals of the persisted table, which keeps name, company number, email and phone only."""
    rows = [("email_exact", "email"), ("full_name", "name"), ("phone", "phone"), ("duns_number", "duns_number")]
    entries = [(t, F.col(c), (c,)) for t, c in rows]
    return _long(executives, "subject_id", entries).withColumnRenamed("ref", "identity_id")


def candidates(incoming: DataFrame, stored: DataFrame, profile: IdentityProfile | None = None, hot: int = HOT) -> DataFrame:
    """ref, identity_id: at most `most_candidates` a record, by ascending identity.

    A value that more than `hot` records hold is joined in several tasks.  On the stored side the limit of a value's
    identities acts before the shuffle (a window's group limit), so a common value sends a few rows from each task."""
    profile = profile or IdentityProfile()
    blocking = [t for t, s in profile.signals.items() if s[2]]
    a = incoming.where(F.col("signal_type").isin(*blocking)).select("ref", "signal_type", "value")
    b = stored.where(F.col("signal_type").isin(*blocking)).select("identity_id", "signal_type", "value")
    # A record's first identities are among the first of each of its values: a common value must not meet every record.
    place = F.row_number().over(Window.partitionBy("signal_type", "value").orderBy("identity_id"))
    b = b.distinct().withColumn("place", place).where(F.col("place") <= profile.most_candidates).drop("place")
    pairs = salted_join(a, b, ["signal_type", "value"], ["ref"], hot=hot).select("ref", "identity_id").distinct()
    nth = F.row_number().over(Window.partitionBy("ref").orderBy("identity_id"))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= profile.most_candidates).drop("nth")


def _mine(incoming: DataFrame, profile: IdentityProfile, *more: str) -> DataFrame:
    """Each record's signals with their weight and, where a difference counts against a pair, the type's bit; in order."""
    weight = X.lookup(F.col("signal_type"), {t: s[1] for t, s in profile.signals.items()})
    bit = X.lookup(F.col("signal_type"), _bits(profile))
    return incoming.withColumn("_s", F.struct("position", "signal_type", weight.alias("weight"), "tier", bit.alias("bit"), "value", *more)).groupBy("ref").agg(F.sort_array(F.collect_list("_s")).alias("mine"))


def _bits(profile: IdentityProfile) -> dict[str, int]:
    return {t: 1 << k for k, t in enumerate(t for t, s in profile.signals.items() if s[3])}


def _held(stored: DataFrame) -> DataFrame:
    """identity_id, held: its distinct signals (signal_type, value, last); of several values of a type one is the last."""
    every = stored.groupBy("identity_id").agg(F.sort_array(F.collect_set(F.struct("signal_type", "position", "value"))).alias("held"))
    last = lambda x: F.element_at(F.filter("held", lambda y: y["signal_type"] == x["signal_type"]), -1)["value"] == x["value"]
    return every.select("identity_id", F.array_distinct(F.transform("held", lambda x: F.struct(x["signal_type"], x["value"], last(x).alias("last")))).alias("held"))


def matched(incoming: DataFrame, stored: DataFrame, profile: IdentityProfile | None = None, hot: int = HOT) -> DataFrame:
    """ref, candidates, scored, sure (arrays of identity_id, score, weak, supporting, contradicting), doubtful (one such);
    one row a record with signals.  scored: all its candidates by ascending identity; sure: those that are not weak;
    doubtful: the first of the others.  Whoever reads no `scored` has the weak ones, nearly all, counted and not scored.

    Candidates never become rows of a shuffle.  A value's list (`most_candidates` identities at most) says which identities
    no longer have it as their last, and of each which types it has a value of; the lists of a record's own values meet in
    its row.  That is all a score needs: a record's candidate that has one of its values is among the first of that value's
    list, as all before it there are candidates too.  Types that do not block come with each identity."""
    profile = profile or IdentityProfile()
    profile.validate()
    blocking = [t for t, s in profile.signals.items() if s[2]]
    blocks = F.col("signal_type").isin(*blocking)
    holds = lambda t: F.exists("held", lambda y: y["signal_type"] == t)
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(holds(t), n).otherwise(0) for t, n in _bits(profile).items()], F.lit(0))
    other = F.transform(F.filter("held", lambda x: ~x["signal_type"].isin(*blocking) & x["last"]), lambda x: F.struct(F.col("identity_id"), x["signal_type"], x["value"]))
    # Inline's own filter, which an outer one lacks, would make `held` twice.
    rows = _held(stored).withColumns({"mask": mask, "other": other}).select("identity_id", "mask", "other", F.inline_outer("held")).where(blocks)
    place = F.row_number().over(Window.partitionBy("signal_type", "value").orderBy("identity_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= profile.most_candidates)
    lists = rows.groupBy("signal_type", "value").agg(F.sort_array(F.collect_list(F.struct("identity_id", "last", "mask", "other"))).alias("_in"))
    parts = {"names": F.transform("_in", lambda x: x["identity_id"]), "stale": F.transform(F.filter("_in", lambda x: ~x["last"]), lambda x: x["identity_id"]), "masks": F.transform("_in", lambda x: x["mask"]), "others": F.flatten(F.transform("_in", lambda x: x["other"]))}
    lists = lists.select("signal_type", "value", F.struct(*[c.alias(n) for n, c in parts.items()]).alias("ids"))

    joined = salted_join(incoming.where(blocks).select("ref", "position", "signal_type", "value", "tier"), lists, ["signal_type", "value"], ["ref"], "left", hot)
    # A value that blocks has done its work in the join.
    joined = joined.withColumn("value", F.lit(None).cast("string"))
    rest = incoming.where(~blocks).select("ref", "position", "signal_type", "value", "tier").withColumn("ids", F.lit(None).cast(lists.schema["ids"].dataType))
    # A column that a lambda names is made again at each of its calls, unless the step that names it does so twice: then it
    # stays a column of its own, as `mine` and `_all` do, and those beside it.
    every = lambda c: F.flatten(F.filter(F.transform("mine", lambda x: x["ids"][c]), lambda x: x.isNotNull()))
    out = _mine(joined.unionByName(rest), profile, "ids").withColumns({"_all": F.sort_array(every("names")), "_others": every("others")})
    # An identity that is not weak is in several lists, or in that of a strong signal, or has signals that do not block.
    often = F.filter("_all", lambda x, k: F.get("_all", k + profile.independent - 1) == x)
    strong = F.flatten(F.filter(F.transform(F.filter("mine", lambda x: x["tier"] == "strong"), lambda x: x["ids"]["names"]), lambda x: x.isNotNull()))
    out = out.withColumns({"_found": F.slice(F.array_distinct("_all"), 1, profile.most_candidates), "_may": F.concat(often, strong, F.transform("_others", lambda x: x["identity_id"]))})

    beside = lambda x, i: F.exists("_others", lambda o: (o["identity_id"] == i) & (o["signal_type"] == x["signal_type"]) & (o["value"] == x["value"]))
    same = lambda x, i: F.when(x["value"].isNotNull(), beside(x, i)).otherwise(F.coalesce(F.array_contains(x["ids"]["names"], i) & ~F.array_contains(x["ids"]["stale"], i), F.lit(False)))
    place = lambda x, i: F.array_position(x["ids"]["names"], i).cast("int") - 1
    masks = lambda i: F.filter(F.transform("mine", lambda x: F.get(x["ids"]["masks"], place(x, i))), lambda n: n.isNotNull())
    marks = lambda c: F.transform("mine", lambda x: _mark(x, same(x, c["identity_id"]), c["mask"].bitwiseAND(x["bit"]) > 0))

    def scored(ids: Column) -> Column:
        met = F.transform(ids, lambda i: F.struct(i.alias("identity_id"), F.get(masks(i), F.lit(0)).alias("mask")))
        met = F.transform(met, lambda c: F.struct(c["identity_id"], marks(c).alias("marks")))
        return F.transform(F.transform(met, lambda c: _split(c["marks"], c["identity_id"])), lambda c: _verdict(c, profile))

    out = out.withColumn("sure", F.filter(scored(F.array_intersect("_found", "_may")), lambda c: ~c["weak"]))
    doubtful = F.slice(F.array_except("_found", F.transform("sure", lambda c: c["identity_id"])), 1, 1)
    return out.select("ref", F.size("_found").alias("candidates"), scored(F.col("_found")).alias("scored"), "sure", F.get(scored(doubtful), F.lit(0)).alias("doubtful"))


def _mark(x: Column, same: Column, known: Column) -> Column:
    return F.struct(x["signal_type"].alias("signal_type"), x["weight"].alias("weight"), x["tier"].alias("tier"), same.alias("same"), known.alias("known"))


def _split(marks: Column, identity_id: Column) -> Column:
    """What speaks for a pair and what against it, in signal order."""
    return F.struct(identity_id.alias("identity_id"), F.filter(marks, lambda x: x["same"]).alias("yes"), F.filter(marks, lambda x: ~x["same"] & x["known"]).alias("no"))


def _verdict(c: Column, profile: IdentityProfile) -> Column:
    """identity_id, score, weak, supporting, contradicting of a pair (identity_id, yes, no)."""
    types = lambda x: F.transform(x, lambda y: y["signal_type"])
    add = lambda x, w: F.aggregate(x, F.lit(0.0), lambda s, y: s + w(y))  # noqa: E731  in signal order
    weak = ~F.exists(c["yes"], lambda x: x["tier"] == "strong") & (F.size(F.array_distinct(types(c["yes"]))) < profile.independent)
    total = add(c["yes"], lambda y: y["weight"]) + add(c["no"], lambda y: F.lit(-profile.penalty))
    value = F.when(weak, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return F.struct(c["identity_id"].alias("identity_id"), value.alias("score"), weak.alias("weak"), types(c["yes"]).alias("supporting"), types(c["no"]).alias("contradicting"))


def _band(c: Column, profile: IdentityProfile) -> Column:
    return F.when(c["weak"], "no_match").when(c["score"] >= profile.auto_merge, "auto_merge").when(c["score"] >= profile.review, "candidate_review").otherwise("no_match")


def _reason(c: Column, profile: IdentityProfile) -> Column:
    listed = lambda x: F.when(F.size(x) == 0, "none").otherwise(F.array_join(x, ", "))
    quoted = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.array_distinct(c["supporting"])), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    too_few = F.concat(F.lit(f"No Strong-tier signal matched, and fewer than {profile.independent} independent corroborating signal type(s) were found ("), F.when(F.size(c["supporting"]) == 0, "none").otherwise(quoted), F.lit(") — a single weak or moderate signal is never sufficient on its own."))
    said = F.concat(F.lit("score="), F.format_string("%.3f", c["score"]), F.lit(" -> "), _band(c, profile), F.lit("; supporting=["), listed(c["supporting"]), F.lit("]; contradicting=["), listed(c["contradicting"]), F.lit("]"))
    return F.when(c["weak"], too_few).otherwise(said)


def _told(rows: DataFrame, profile: IdentityProfile, *keep: str) -> DataFrame:
    """keep, score, supporting, contradicting, band, reason of pairs `_c`."""
    c = F.col("_c")
    return rows.select(*keep, c["score"].alias("score"), c["supporting"].alias("supporting"), c["contradicting"].alias("contradicting"), _band(c, profile).alias("band"), _reason(c, profile).alias("reason"))


def scores(incoming: DataFrame, stored: DataFrame, pairs: DataFrame, profile: IdentityProfile | None = None, how: str = "inner") -> DataFrame:
    """pairs (ref, identity_id and others) with score, supporting, contradicting (arrays of signal types), band, reason.

    A record's and an identity's signals are one row each.  how: inner, or left: a record without signals has nulls."""
    profile = profile or IdentityProfile()
    profile.validate()
    last = _held(stored).select("identity_id", F.filter("held", lambda x: x["last"]).alias("held"))
    joined = pairs.join(_mine(incoming, profile), "ref", how).join(last, "identity_id", "left")
    value = lambda x: F.get(F.filter("held", lambda y: y["signal_type"] == x["signal_type"]), F.lit(0))["value"]
    joined = joined.withColumn("mine", F.transform("mine", lambda x: F.struct(x["signal_type"], x["weight"], x["tier"], x["bit"], x["value"], value(x).alias("stored"))))
    marks = F.transform("mine", lambda x: _mark(x, F.coalesce(x["stored"] == x["value"], F.lit(False)), x["stored"].isNotNull() & x["bit"].isNotNull()))
    joined = joined.withColumn("_c", F.when(F.col("mine").isNotNull(), _split(marks, F.col("identity_id")))).withColumn("_c", F.when(F.col("_c").isNotNull(), _verdict(F.col("_c"), profile)))
    told = _told(joined, profile, *[f"`{c}`" for c in pairs.columns], "_c")
    known = F.col("_c").isNotNull()
    return told.withColumns({"band": F.when(known, F.col("band")), "reason": F.when(known, F.col("reason"))}).drop("_c")


def decisions(records: DataFrame, scored: DataFrame, profile: IdentityProfile | None = None) -> DataFrame:
    """ref, decision, matched_id, new_id, candidates, review (array by descending score), rationale; one row a record.

    scored: as `matched` has it.  Weak candidates, which score 0, are never merged or reviewed; the best may be one."""
    profile = profile or IdentityProfile()
    of = lambda band: F.filter("sure", lambda c: _band(c, profile) == band)
    ranked = lambda c, *x: F.struct((-c["score"]).alias("minus"), c["identity_id"].alias("identity_id"), *x)
    best = scored.select(
        "ref",
        F.nullif(F.col("candidates"), F.lit(0)).cast("long").alias("candidates"),
        F.array_max(F.transform(of("auto_merge"), lambda c: F.struct(c["score"], c["identity_id"].alias("identity_id"))))["identity_id"].alias("merge_id"),
        F.transform(F.sort_array(F.transform(of("candidate_review"), lambda c: ranked(c))), lambda c: c["identity_id"]).alias("review"),
        # Of equal scores the first identity.
        F.array_min(F.transform(F.concat("sure", F.filter(F.array("doubtful"), lambda c: c.isNotNull())), lambda c: ranked(c, c["score"].alias("score"), c["weak"].alias("weak"), c["supporting"].alias("supporting"), c["contradicting"].alias("contradicting")))).alias("best"),
    )
    out = records.select("ref").distinct().join(best, "ref", "left")
    decision = F.when(F.col("merge_id").isNotNull(), "auto_merge").when(F.size("review") > 0, "candidate_review").otherwise("new_identity")
    out = out.withColumn("decision", decision)
    return out.select(
        "ref",
        "decision",
        F.when(F.col("decision") == "auto_merge", F.col("merge_id")).alias("matched_id"),
        F.when(F.col("decision") == "new_identity", F.sha2(F.concat_ws("|", F.lit("identity"), F.col("ref").cast("string")), 256)).alias("new_id"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.when(F.col("decision") == "candidate_review", F.col("review")).alias("review"),
        F.when(F.col("candidates").isNull(), F.lit("No candidate shared a blocking signal.")).otherwise(F.concat(F.col("decision"), F.lit(": "), _reason(F.col("best"), profile))).alias("rationale"),
    )


def resolve(records: DataFrame, ref: str, stored: DataFrame, subject: str = "person", profile: IdentityProfile | None = None) -> dict[str, DataFrame]:
    """signals, pairs (scored), outcomes, audit and review queue of a dataset."""
    signals = person_signals(records, ref) if subject == "person" else company_signals(records, ref)
    profile = profile or IdentityProfile()
    scored = matched(signals, stored, profile)
    pairs = scored.select("ref", F.explode_outer("scored").alias("_c")).where("_c is not null")  # explode's own filter would score twice
    outcomes = decisions(records.select(F.col(ref).alias("ref")), scored, profile)
    # Only records to review have a list.  A filter by decision, or explode's own, would score every record several times.
    review = outcomes.select("ref", F.posexplode_outer("review").alias("rank", "identity_id"), F.lit("open").alias("status")).where("rank is not null")
    return {"signals": signals, "pairs": _told(pairs, profile, "ref", F.col("_c")["identity_id"].alias("identity_id")), "outcomes": outcomes, "audit": outcomes.select("ref", "decision", "rationale"), "review_queue": review}


def metrics(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in ("auto_merge", "candidate_review", "new_identity")]
    one = outcomes.agg(F.count("*").alias("records"), *counts, F.sum("candidates").alias("candidates"))
    return one.withColumn("_one", F.lit(1)).join(signals.agg(F.count("*").alias("signals")).withColumn("_one", F.lit(1)), "_one").drop("_one")


def recompute(queue: DataFrame, incoming: DataFrame, stored: DataFrame, profile: IdentityProfile | None = None) -> DataFrame:
    """Scores the queued pairs (ref, identity_id, band) against new evidence: band before and after."""
    again = scores(incoming, stored, queue.select("ref", "identity_id", F.col("band").alias("band_before")), profile, "left")
    return again.select("ref", "identity_id", "band_before", "score", F.col("band").alias("band_after"), (~F.col("band_before").eqNullSafe(F.col("band"))).alias("changed"))
