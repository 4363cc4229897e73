"""The cleaning pipeline: mapping, staged rules, change capture, warnings, metrics.

Normalizations run in registry order, safe ones before business ones, each seeing what the ones
before it made.  Every value that a rule may write becomes a column of its own, so that the plan is a
stack of projections (Catalyst must not copy an expression into everything that reads it); rules that do
not read each other's fields share a projection.  The audit arrays compare those columns.  Nothing is
shuffled before the metrics.

A rule that raises for a record is a failure of that record: its fields keep the values that they had,
and all other rules run.  A rule that Spark refuses, or whose code raises while the plan is built, fails
for every record alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions import guard as G
from dossier.functions import text as X
from dossier.operators.rules import BUSINESS, RULES, SAFE, WARNING, ConfigurationError, Record, Rule

CHANGE = "struct<rule_id:string,rule_version:int,field_name:string,old_value:string,new_value:string,stage:string,at:timestamp>"
NOTE = "struct<rule_id:string,rule_version:int,code:string,message:string,field_names:array<string>,at:timestamp>"
FAILURE = "struct<rule_id:string,rule_version:int,stage:string,error_message:string,at:timestamp>"


@dataclass(frozen=True)
class Profile:
    """Which rules run, with which parameters."""

    name: str = "default"
    business: bool = True
    warnings: bool = True
    enabled_rules: dict[str, bool] = field(default_factory=dict)
    parameters: dict[str, dict] = field(default_factory=dict)
    only: tuple[str, ...] | None = None
    #: The registry; a caller's own rules go behind the built-in ones.
    rules: tuple[Rule, ...] = tuple(RULES)

    def rule(self, rule_id: str) -> Rule:
        found = next((r for r in self.rules if r.id == rule_id), None)
        if found is None:
            raise ConfigurationError(f"no rule {rule_id}")
        return found

    def enabled(self, rule_id: str) -> bool:
        rule = self.rule(rule_id)
        if self.only is not None:
            return rule_id in self.only
        if rule.stage == SAFE:
            return True
        if rule.stage == BUSINESS and not self.business or rule.stage == WARNING and not self.warnings:
            return False
        return self.enabled_rules.get(rule_id, rule.default)

    def params(self, rule_id: str) -> dict:
        return self.parameters.get(rule_id, {})

    def running(self, stage: str) -> list[Rule]:
        return [r for r in self.rules if r.stage == stage and self.enabled(r.id)]

    def validate(self) -> None:
        if not self.name.strip():
            raise ConfigurationError("a profile needs a name")
        if len({r.id for r in self.rules}) < len(self.rules):
            raise ConfigurationError("two rules have one id")
        for rule_id in (*self.enabled_rules, *self.parameters, *(self.only or ())):
            self.rule(rule_id)
        for rule_id, on in self.enabled_rules.items():
            if not on and self.rule(rule_id).stage == SAFE:
                raise ConfigurationError(f"{rule_id} is a safe rule and cannot be disabled")
        for rule in self.rules:
            if rule.validate:
                rule.validate(self)


def map_fields(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns from literal headers; a header that the table lacks gives null.  Other columns stay behind."""
    mapping = mapping or R.FIELD_HEADERS
    kept = [c for c in ("row_number", "sheet_name") if c in df.columns]
    return df.select(*kept, *[(F.col(f"`{h}`") if h in df.columns else F.lit(None).cast("string")).alias(name) for name, h in mapping.items()])


class _Seen(Mapping):
    """What a rule looks up; a field that waits to be written is written before it is looked at."""

    def __init__(self, stack: _Stack, value: Callable[[str], object]):
        self.stack, self.value = stack, value

    def __getitem__(self, name: str):
        if name in self.stack.pending:
            self.stack.flush()
        return self.value(self.stack.latest[name])

    def __iter__(self) -> Iterator[str]:
        return iter({**self.stack.latest, **dict.fromkeys(self.stack.pending)})

    def __contains__(self, name: object) -> bool:
        return name in self.stack.latest or name in self.stack.pending

    def __len__(self) -> int:
        return len(list(iter(self)))


class _Stack:
    """Records while the normalizations run: the column that holds each field's latest value, and what waits for
    the next projection."""

    def __init__(self, df: DataFrame, profile: Profile):
        self.df, self.profile = df, profile
        self.latest = {c: c for c in df.columns}
        self.kinds = dict(df.dtypes)
        self.captured: list[tuple[Rule, str, str, str | None]] = []
        self.touched: dict[str, str] = {}  # rule -> the column that says whether it counts the record as affected
        self.errors: dict[str, str] = {}  # rule -> the column that says why it failed
        self.failed: dict[str, str] = {}  # rule -> why it fails for every record
        self.waiting: list[tuple[Rule, dict[str, Column], Column | None]] = []
        self.pending: set[str] = set()

    def record(self) -> Record:
        def composed(name: str) -> str | None:
            return c if (c := f"_nfc_{name}") in self.kinds and self.latest[name] == name else None

        return Record(_Seen(self, lambda c: F.col(f"`{c}`")), _Seen(self, lambda c: self.kinds[c]), composed)

    def compose(self) -> None:
        """Texts that white space rules will compose, once, beneath all rules."""
        fields = {f for r in self.profile.running(SAFE) for f in getattr(r.apply, "composes", ())}
        new = {f"_nfc_{f}": X.nfc(F.col(f"`{f}`")) for f in self.latest if f in fields and self.kinds[f] == "string"}
        if new:
            self.df = self.df.withColumns(new)
            self.kinds |= dict.fromkeys(new, "string")

    def add(self, rule: Rule) -> None:
        record, params = self.record(), self.profile.params(rule.id)
        try:
            values = rule.apply(record, params)
            touches = F.coalesce(rule.touches(record, params), F.lit(False)) if rule.touches else None
        except Exception as error:  # one rule must not sink the run
            self.failed[rule.id] = str(error)
            return
        if rule.total:
            if self.pending & set(values):
                self.flush()
            self.waiting.append((rule, values, touches))
            self.pending |= set(values)
            return
        self.flush()
        try:
            self._guarded(rule, values, touches)
        except Exception as error:
            self.failed[rule.id] = str(error)

    def flush(self) -> None:
        waiting, self.waiting, self.pending = self.waiting, [], set()
        if not waiting:
            return
        try:
            self._write(waiting)
        except Exception:  # some rule's columns are refused: which one's?
            for one in waiting:
                try:
                    self._write([one])
                except Exception as error:
                    self.failed[one[0].id] = str(error)

    def _write(self, entries: list[tuple[Rule, dict[str, Column], Column | None]]) -> None:
        new = {}
        for rule, values, touches in entries:
            new |= {_own(rule, f): c for f, c in values.items()} | ({_own(rule, "touched_"): touches} if touches is not None else {})
        if new:
            df = self.df.withColumns(new)
            self.df, self.kinds = df, self.kinds | {c: t for c, t in df.dtypes if c in new}
        for rule, values, touches in entries:
            if touches is not None:
                self.touched[rule.id] = _own(rule, "touched_")
            for f in values:
                self.captured.append((rule, f, _own(rule, f), self.latest.get(f)))
                self.latest[f] = _own(rule, f)

    def _guarded(self, rule: Rule, values: dict[str, Column], touches: Column | None) -> None:
        """A rule that may raise for a record: evaluated apart; where it raises, the fields stay as they were."""
        names = {f: _own(rule, f) for f in values}
        raw = {names[f] + "raw_": c for f, c in values.items()} | ({_own(rule, "touched_raw_"): touches} if touches is not None else {})
        if not raw:
            return
        kinds = dict(self.df.select(*[c.alias(n) for n, c in raw.items()]).dtypes)
        for n, kind in kinds.items():
            if not G.is_result(kind) and not G.carried(kind):
                raise ConfigurationError(f"a value of type {kind} cannot be guarded; give a result of value and error")
        df = self.df.withColumns({n: c if G.is_result(kinds[n]) else G.packed(c) for n, c in raw.items()})
        got = {n: (F.col(f"`{n}`")["value"], F.col(f"`{n}`")["error"]) if G.is_result(k) else (G.unpacked(F.col(f"`{n}`"), k), F.when(G.raised(F.col(f"`{n}`")), F.lit(_raised(rule)))) for n, k in kinds.items()}
        df = df.withColumn(_own(rule, "error_"), F.coalesce(*[e for _, e in got.values()]))
        fine = F.col(f"`{_own(rule, 'error_')}`").isNull()
        new = {}
        for f in values:
            before = F.col(f"`{self.latest[f]}`") if f in self.latest else F.lit(None)
            new[names[f]] = F.when(fine, got[names[f] + "raw_"][0]).otherwise(before)
        if touches is not None:
            new[_own(rule, "touched_")] = fine & F.coalesce(got[_own(rule, "touched_raw_")][0], F.lit(False))
        df = df.withColumns(new)
        self.df, self.kinds = df, self.kinds | {c: t for c, t in df.dtypes if c in new}
        self.errors[rule.id] = _own(rule, "error_")
        if touches is not None:
            self.touched[rule.id] = _own(rule, "touched_")
        for f in values:
            self.captured.append((rule, f, names[f], self.latest.get(f)))
            self.latest[f] = names[f]


def _own(rule: Rule, name: str) -> str:
    return f"_{rule.id.removeprefix('CLN-')}_{name}"


def _raised(rule: Rule) -> str:
    return f"{rule.id} raised an error for this record"


def _failure(rule: Rule, message: Column, at: Column) -> Column:
    return F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.version).alias("rule_version"), F.lit(rule.stage).alias("stage"), message.alias("error_message"), at.alias("at"))


def clean(df: DataFrame, profile: Profile | None = None, now: Column | None = None) -> DataFrame:
    """df with cleaned columns (and derived ones), changes: array of CHANGE, warnings: array of NOTE, affected: array
    of rule ids, failures: array of FAILURE.

    now: the time of the run."""
    profile = profile or Profile()
    now_ = F.current_timestamp() if now is None else now
    profile.validate()
    stack = _Stack(df, profile)
    stack.compose()
    for stage in (SAFE, BUSINESS):
        for rule in profile.running(stage):
            stack.add(rule)
    stack.flush()
    out, kinds, latest = stack.df, stack.kinds, stack.latest

    def text(c: str | None) -> Column:
        if c is None:
            return F.lit(None).cast("string")
        return X.number(F.col(f"`{c}`")) if kinds[c] == "double" else F.col(f"`{c}`").cast("string")

    changes = []
    order = {r.id: k for k, r in enumerate([*profile.running(SAFE), *profile.running(BUSINESS)])}
    for rule, name, column, before in sorted(stack.captured, key=lambda x: order[x[0].id]):
        differs = ~F.col(f"`{column}`").eqNullSafe(F.col(f"`{before}`") if before else F.lit(None))
        changes.append(F.when(differs, F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.version).alias("rule_version"), F.lit(name).alias("field_name"), text(before).alias("old_value"), text(column).alias("new_value"), F.lit(rule.stage).alias("stage"), now_.alias("at"))))
    found = F.filter(F.array(*changes), lambda x: x.isNotNull()) if changes else F.array().cast(f"array<{CHANGE}>")
    fields = [*df.columns, *[f for f in latest if f not in df.columns]]
    marks = F.array(*[F.when(F.col(f"`{c}`"), F.lit(r)) for r, c in stack.touched.items()]) if stack.touched else F.array().cast("array<string>")
    errors = [F.when(F.col(f"`{c}`").isNotNull(), _failure(profile.rule(r), F.col(f"`{c}`"), now_)) for r, c in stack.errors.items()]
    out = out.select(*[F.col(f"`{latest[f]}`").alias(f) for f in fields], found.cast(f"array<{CHANGE}>").alias("changes"), marks.alias("_marks"), *([F.array(*errors).alias("_errors")] if errors else []))
    affected = F.array_distinct(F.concat(F.col("changes.rule_id"), F.filter("_marks", lambda x: x.isNotNull())))
    out = out.select(*fields, "changes", affected.alias("affected"), *(["_errors"] if errors else []))
    out, notes, more = _checked(out, fields, profile, stack.failed, now_)
    warned = F.filter(F.array(*notes), lambda x: x.isNotNull()) if notes else F.array().cast(f"array<{NOTE}>")
    always = [_failure(profile.rule(r), F.lit(e), now_) for r, e in stack.failed.items()]
    failures = F.concat(*([F.col("_errors")] if errors else []), F.array(*always, *more).cast(f"array<{FAILURE}>")) if errors else F.array(*always, *more)
    failures = F.filter(failures.cast(f"array<{FAILURE}>"), lambda x: x.isNotNull())
    return out.select(*fields, "changes", "affected", warned.cast(f"array<{NOTE}>").alias("warnings"), failures.alias("failures"))


def _checked(out: DataFrame, fields: list[str], profile: Profile, failed: dict[str, str], at: Column) -> tuple[DataFrame, list[Column], list[Column]]:
    """The checks' notes and failures as columns over the frame that is returned."""
    record = Record({f: F.col(f"`{f}`") for f in fields}, dict(out.dtypes))
    total: list[tuple[Rule, list[Column]]] = []
    guarded: dict[str, Column] = {}
    notes: list[Column] = []
    failures: list[Column] = []

    def note(rule: Rule, d, when: Column, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.version).alias("rule_version"), F.lit(d.code).alias("code"), message.alias("message"), F.array(*[F.lit(x) for x in d.fields]).alias("field_names"), at.alias("at")))

    for rule in profile.running(WARNING):
        try:
            drafts = rule.apply(record, profile.params(rule.id))
        except Exception as error:
            failed[rule.id] = str(error)
            continue
        said = [F.lit(d.message) if isinstance(d.message, str) else d.message for d in drafts]
        if rule.total:
            total.append((rule, [note(rule, d, d.when, m) for d, m in zip(drafts, said)]))
            continue
        # The message where the check holds: null where it does not, and a failure where it raises.
        own = {_own(rule, f"{k}_"): G.packed(F.when(d.when, m)) for k, (d, m) in enumerate(zip(drafts, said))}
        try:
            out.select(*own.values())
        except Exception as error:
            failed[rule.id] = str(error)
            continue
        guarded |= own
        wrong = [G.raised(F.col(f"`{n}`")) for n in own]
        bad = wrong[0] if wrong else F.lit(False)
        for w in wrong[1:]:
            bad = bad | w
        failures.append(F.when(bad, _failure(rule, F.lit(_raised(rule)), at)))
        total.append((rule, [note(rule, d, ~bad & G.unpacked(F.col(f"`{n}`"), "string").isNotNull(), G.unpacked(F.col(f"`{n}`"), "string")) for n, d in zip(own, drafts)]))
    if guarded:
        out = out.withColumns(guarded)
    every = [c for _, own in total for c in own]
    try:
        out.select(F.array(*every)) if every else None
        notes = every
    except Exception:  # some check's columns are refused: which one's?
        for rule, own in total:
            try:
                out.select(F.array(*own)) if own else None
                notes += own
            except Exception as error:
                failed[rule.id] = str(error)
    return out, notes, failures


def audit_trail(cleaned: DataFrame, key: str) -> DataFrame:
    """One row per change and warning, in run order within a record.

    explode_outer, here and below: for a plain explode Catalyst infers a filter on the array and pushes it
    through the stack of projections, copying what it reads at every level."""
    changes = cleaned.select(key, F.posexplode_outer("changes").alias("position", "x")).select(key, "position", F.lit("change").alias("kind"), "x.rule_id", "x.rule_version", "x.at", "x.field_name", F.col("x.old_value").alias("old_value"), F.col("x.new_value").alias("new_value"), F.lit(None).cast("string").alias("code"))
    warnings = cleaned.select(key, F.posexplode_outer("warnings").alias("position", "x")).select(key, "position", F.lit("warning").alias("kind"), "x.rule_id", "x.rule_version", "x.at", F.array_join("x.field_names", ",").alias("field_name"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"), "x.code")
    return changes.unionByName(warnings).where("rule_id is not null")


def failure_rows(cleaned: DataFrame, key: str) -> DataFrame:
    """One row per record and rule that failed for it."""
    return cleaned.select(key, F.explode_outer("failures").alias("x")).where("x is not null").select(key, "x.*")


def rule_metrics(cleaned: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Per rule: records evaluated, skipped (the profile has it off), affected (changed, counted as touched, or warned
    of), changes, warnings, failures.

    One pass over the records: each gives a line for itself and for every event, and their counts by rule
    meet in one row."""
    profile = profile or Profile()
    spark = cleaned.sparkSession

    def lines(ids: str | Column, what: str) -> Column:
        return F.transform(ids, lambda r: F.struct(r.alias("rule_id"), F.lit(what).alias("what")))

    seen = F.array(F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit("record").alias("what")))
    touched = F.array_union("affected", F.col("warnings.rule_id"))
    events = cleaned.select(F.explode(F.concat(seen, lines(F.col("changes.rule_id"), "change"), lines(touched, "affected"), lines(F.col("warnings.rule_id"), "warning"), lines(F.col("failures.rule_id"), "failure"))).alias("e")).select("e.*")
    # A few lines for each rule, as one row.
    counts = events.groupBy("rule_id", "what").count().agg(F.collect_list(F.struct("rule_id", "what", "count")).alias("c"))
    rules = spark.createDataFrame([(r.id, r.version, r.stage, r.category, profile.enabled(r.id)) for r in profile.rules], "rule_id string, rule_version int, stage string, category string, enabled boolean")
    one = rules.crossJoin(F.broadcast(counts))

    def count(what: str, rule: Column | None = None) -> Column:
        own = F.filter("c", lambda x: (x["what"] == what) & (x["rule_id"].eqNullSafe(rule) if rule is not None else x["rule_id"].isNull()))
        return F.coalesce(F.get(own, F.lit(0))["count"], F.lit(0)).cast("long")

    r, total = F.col("rule_id"), count("record")
    evaluated, skipped = F.when(F.col("enabled"), total).otherwise(0).alias("records_evaluated"), F.when(F.col("enabled"), 0).otherwise(total).alias("records_skipped")
    return one.select("rule_id", "rule_version", "stage", "category", evaluated, skipped, count("affected", r).alias("records_affected"), count("change", r).alias("changes"), count("warning", r).alias("warnings"), count("failure", r).alias("failures"))


def _totals() -> list[Column]:
    own = F.filter("failures", lambda x: x["stage"] != WARNING)  # a check that fails leaves the record as it is
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count("*").alias("records"),
        F.count_if(F.size("changes") > 0).alias("records_with_changes"),
        F.count_if(F.size("warnings") > 0).alias("records_with_warnings"),
        F.count_if(F.size(own) > 0).alias("records_with_failures"),
        add(F.size("changes")).alias("changes"),
        add(F.size("warnings")).alias("warnings"),
        add(F.size(own)).alias("failures"),
    ]


def run_report(cleaned: DataFrame) -> DataFrame:
    """Totals of a run."""
    return cleaned.agg(*_totals())


def observed(cleaned: DataFrame, name: str = "cleaning run") -> tuple[DataFrame, Observation]:
    """cleaned, and the totals of run_report as an observation that the first action on it fills: no pass of their own."""
    seen = Observation(name)
    return cleaned.observe(seen, *_totals()), seen
