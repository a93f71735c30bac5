"""Quality rules combined by weak supervision, in DataFrame functions only.

Every rule looks at a few counts of a text and votes good (2), bad (0) or
abstains (1).  Each rule watches for one kind of fault.  A latent class explains
the votes of a document: it is good, or it has one of the ``KINDS`` of faults.
Rules are independent given the class, and expectation-maximisation estimates
for every rule how often it votes what in every class, i.e. its accuracies.  As
each kind of fault is a class of its own, rules of one kind may agree as often
as they like without being taken for independent evidence against the good
class, and a kind that few rules see doesn't drift into it.  A document can only
have a fault of which a rule of that kind accuses it; so where faults are rare,
their classes don't take in clean documents.

A text is kept when its posterior probability of being good reaches the
threshold: a bad vote that the other votes of its kind contradict does not
decide, and abstentions count for what they are worth in each class.

The counts need one pass over the texts.  Expectation-maximisation runs on the
table of vote patterns with their frequencies (at most 3^rules rows whatever the
input) as one expression over one row; the fitted model, a few hundred numbers,
comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import materialise

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
ROUNDS = 12
KINDS = ("symbols", "repetition", "shouting", "fragments")
#: Counts that are added per (rule, class, vote), in the order bad, abstain, good: a rule that watches for the
#: class's own fault, and any other rule (all of them in the good class).
OWN, OTHER = (2.0, 0.5, 0.5), (0.25, 0.5, 2.0)
#: Start: weights of the good class, and of a kind for each bad vote of its rules, with one bad vote (or none) and with more.
START_GOOD, START_FAULT = (1.0, 0.1), (0.3, 1.0)
#: Log-likelihood of a kind none of whose rules accuses.
NEVER = -1000.0
THRESHOLD = 0.5
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_again", "n_single",
)


@dataclass(frozen=True)
class Rule:
    """A share of two counts; bad above ``bad``, good up to ``good``, else no vote; ``kind`` is the fault it watches for."""

    name: str
    kind: str
    part: str
    over: str
    good: float
    bad: float

    def vote(self) -> Column:
        part, over = F.col(self.part).cast("double"), F.col(self.over).cast("double")
        return F.when(over == 0, 1).when(part <= self.good * over, 2).when(part > self.bad * over, 0).otherwise(1)

    def sql(self) -> str:
        return f"case when {self.over} = 0 then 1 when {self.part}::double <= {self.good} * {self.over}::double then 2 when {self.part}::double > {self.bad} * {self.over}::double then 0 else 1 end"


RULES = (
    Rule("symbols", "symbols", "n_symbols", "word_chars", 0.002, 0.05),
    Rule("long_words", "symbols", "word_chars", "n_words", 6.0, 6.8),
    Rule("repeats", "repetition", "n_repeat_words", "n_words", 0.02, 0.3),
    Rule("stutter", "repetition", "n_again", "n_words", 0.05, 0.3),
    Rule("duplicate_lines", "repetition", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("capitals", "shouting", "n_upper", "word_chars", 0.06, 0.4),
    Rule("exclamations", "shouting", "n_marks", "n_words", 0.05, 0.5),
    Rule("single_letters", "fragments", "n_single", "n_words", 0.06, 0.25),
)


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; windows[i] starts at word i."""
    # hash and start sorted together: equal windows become neighbours
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    add = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
    return F.aggregate(_bind(ordered, starts), zero, add, lambda a: a["n"])


def _repeat_words(hashes: Column) -> Column:
    n = F.size(hashes)
    spots = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(spots, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    none = F.lit(0).cast("long")
    return _bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(_covered(w)))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS; columns of these names in ``docs`` are replaced.  Null texts count as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(value, f"{SPACE}+"), "")
    lines = F.filter(F.split(value, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    packed = F.struct(
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(F.translate(value, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        F.regexp_count(value, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(value, F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count(value, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D](?![^\x20\x09-\x0D])")).cast("long").alias("n_single"),
    )
    done = _bind(
        packed,
        lambda p: F.struct(
            F.size(p["hashes"]).cast("long").alias("n_words"), p["word_chars"].alias("word_chars"), p["n_symbols"].alias("n_symbols"),
            p["lines"]["dup"].alias("n_dup_lines"), _repeat_words(p["hashes"]).alias("n_repeat_words"),
            p["lines"]["n"].alias("n_lines"), p["n_upper"].alias("n_upper"), p["n_marks"].alias("n_marks"),
            F.size(F.filter(p["hashes"], lambda h, i: F.get(p["hashes"], i - 1) == h)).cast("long").alias("n_again"), p["n_single"].alias("n_single"),
        ),
    )
    kept = [c for c in docs.columns if c not in COUNTS]
    return docs.select(*kept, done.alias("__counts")).select(*kept, *[F.col(f"__counts.{c}").alias(c) for c in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _added(rules: tuple[Rule, ...]) -> list[list[list[float]]]:
    """Added counts by rule, vote and class; class 0 is the good one."""
    return [[[(OWN if r.kind == k else OTHER)[v] for k in (None, *KINDS)] for v in range(3)] for r in rules]


@dataclass(frozen=True)
class VoteModel:
    """log_prior[class] and log_share[rule][vote][class]; class 0 is the good one."""

    log_prior: tuple[float, ...]
    log_share: tuple[tuple[tuple[float, ...], ...], ...]
    rules: tuple[Rule, ...] = RULES

    def posterior(self, votes: list[Column]) -> Column:
        fits = []
        for k, prior in enumerate(self.log_prior):
            shares = [F.get(F.lit([float(x[k]) for x in share]), vote) for vote, share in zip(votes, self.log_share, strict=True)]
            fits.append(sum(shares, F.lit(float(prior))))
            if k:
                accused = [vote == 0 for vote, rule in zip(votes, self.rules, strict=True) if rule.kind == KINDS[k - 1]]
                fits[k] = F.when(F.array_contains(F.array(*accused), True), fits[k]).otherwise(NEVER) if accused else F.lit(NEVER)
        return 1 / (1 + sum((F.exp(f - fits[0]) for f in fits[1:]), F.lit(0.0)))


def _fit_sql(rules: tuple[Rule, ...], rounds: int) -> str:
    """One expression over ``cells``, the sorted array of (v: votes, n: frequency), that ends in (totals by class, counts by rule, vote and class).

    A state gives every pattern its share w of each class.  Index c of the counts
    stands for rule c div 3K, vote c div K mod 3 and class c mod K.
    """
    many, wide = len(KINDS) + 1, 3 * (len(KINDS) + 1)
    flat = [x for rule in _added(rules) for vote in rule for x in vote]
    added = f"array({', '.join(f'{x}D' for x in flat)})"
    whole = sum(OWN), sum(OTHER)
    wholes = f"array({', '.join(f'{whole[0] if r.kind == k else whole[1]}D' for r in rules for k in (None, *KINDS))})"
    kinds = f"array({', '.join(str(KINDS.index(r.kind) + 1) for r in rules)})"
    mine = f"aggregate(sequence(0, {len(rules) - 1}), 0D, (a, j) -> a + if(p.v[j] = 0 and {kinds}[j] = k, 1D, 0D))"
    many_votes = "size(filter(p.v, x -> x = 0)) > 1"
    start = f"""transform(cells, p -> named_struct('v', p.v, 'n', p.n, 'm', transform(sequence(0, {many - 1}), k -> if(k = 0 or {mine} > 0, 0D, {NEVER}D)),
 'w', transform(sequence(0, {many - 1}), k -> if(k = 0, if({many_votes}, {START_GOOD[1]}D, {START_GOOD[0]}D), if({many_votes}, {START_FAULT[1]}D, {START_FAULT[0]}D) * {mine}))))"""
    scaled = lambda s: f"transform({s}, p -> named_struct('v', p.v, 'n', p.n, 'm', p.m, 'w', transform(p.w, x -> x / aggregate(p.w, 0D, (a, y) -> a + y))))"
    sums = f"""named_struct('t', transform(sequence(0, {many - 1}), k -> aggregate(s, 0D, (a, p) -> a + p.n * p.w[k])),
 'c', transform(sequence(0, {len(rules) * wide - 1}), c -> aggregate(s, 0D, (a, p) -> a + if(p.v[int(c div {wide})] = int(c div {many}) % 3, p.n * p.w[c % {many}], 0D))))"""
    logs = f"""named_struct('p', transform(m.t, t -> ln((t + 1) / (aggregate(m.t, 0D, (a, y) -> a + y) + {many}))),
 'l', transform(m.c, (x, c) -> ln((x + {added}[c]) / (m.t[c % {many}] + {wholes}[int(c div {wide}) * {many} + c % {many}]))))"""
    fits = f"transform(g.p, (x, k) -> aggregate(sequence(0, {len(rules) - 1}), x + p.m[k], (a, j) -> a + g.l[j * {wide} + p.v[j] * {many} + k]))"
    soft = f"transform(array({fits}), f -> transform(f, x -> exp(x - array_max(f))))[0]"
    step = f"transform(array({logs}), g -> transform(s, p -> named_struct('v', p.v, 'n', p.n, 'm', p.m, 'w', {soft})))[0]"
    settled = f"aggregate(sequence(1, {rounds}), {scaled(start)}, (s, i) -> transform(array({sums}), m -> {scaled(step)})[0])"
    return f"transform(array({settled}), s -> transform(array({sums}), m -> {logs})[0])[0]"


def fit(counts: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over the vote patterns of all rows of ``counts`` (an empty table gives the added counts alone)."""
    votes = counts.select(F.array(*[r.vote() for r in rules]).alias("v")).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    model = votes.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("cells")).select(F.expr(_fit_sql(rules, rounds)).alias("m")).first()["m"]
    many = len(KINDS) + 1
    shares = tuple(tuple(tuple(model["l"][(3 * j + v) * many : (3 * j + v + 1) * many]) for v in range(3)) for j in range(len(rules)))
    return VoteModel(tuple(model["p"]), shares, rules)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, with_text: bool = True) -> DataFrame:
    """Adds COUNTS, base_failed, quality (posterior) and kept to every row of ``docs``.

    Columns of these names are replaced.  Empty and null texts fail the base
    rule.  Repeated rows count as often as they occur; texts of any length are
    counted whole; an empty table stays empty.  Texts are never shuffled: they
    are read and counted twice, once to fit, or, where the result need not carry
    them, counted once and the counts written.
    """
    fresh = docs.drop("base_failed", "quality", "kept")
    if with_text:
        model = fit(with_counts(docs.select(text), text), rules)
        counted = with_counts(fresh, text)
    else:
        counted = materialise(with_counts(fresh, text).drop(text))
        model = fit(counted, rules)
    out = counted.withColumn("base_failed", base_failed()).withColumn("quality", model.posterior([r.vote() for r in rules]))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def oracle_ctes(source: str = "documents", rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """DuckDB CTEs that end in ``judged(doc_id, n_words .. n_repeat_words, base_failed, kept)`` for ``source(doc_id, text)``."""
    names = [f"v{j}" for j in range(len(rules))]
    space = r"[\x20\x09-\x0D]"
    own = ", ".join(f"({j}, {KINDS.index(r.kind) + 1})" for j, r in enumerate(rules))
    added = ", ".join(f"({j}, {v}, {k}, {x}, {sum(OWN) if k and rules[j].kind == KINDS[k - 1] else sum(OTHER)})" for j, rule in enumerate(_added(rules)) for v, vote in enumerate(rule) for k, x in enumerate(vote))
    parts = [
        f"""q_text as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from {source}),
q_words as (select rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from q_text),
q_windows as (select rid, unnest(range(1, len(w) - {WINDOW - 2})) as i, w from q_words where len(w) >= {WINDOW}),
q_keys as (select rid, i, hash(array_to_string(w[i:i + {WINDOW - 1}], ' ')) as k, array_to_string(w[i:i + {WINDOW - 1}], ' ') as s from q_windows),
q_twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k, s) as c from q_keys) where c > 1),
q_rep as (select rid, sum(least({WINDOW}, coalesce(i - lag_i, {WINDOW}))) as n_repeat_words from (select rid, i, lag(i) over (partition by rid order by i) as lag_i from q_twice) group by rid),
q_counts as (select rid, doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '{space}', '', 'g'))::bigint as word_chars,
 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
 (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper, (length(text) - length(regexp_replace(text, '[!?]', '', 'g')))::bigint as n_marks,
 len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::bigint as n_again, len(list_filter(w, lambda x: length(x) = 1))::bigint as n_single
 from q_text join q_words using (rid) left join q_rep using (rid)),
q_votes as (select *, {", ".join(f"{r.sql()} as {n}" for r, n in zip(rules, names, strict=True))} from q_counts),
q_patterns as materialized (select row_number() over () as pid, {", ".join(names)}, count(*)::double as n from q_votes group by {", ".join(names)}),
q_long as materialized ({" union all ".join(f"select pid, n, {j} as r, {n} as v from q_patterns" for j, n in enumerate(names))}),
q_own(r, kind) as (values {own}),
q_added(r, v, k, x, whole) as (values {added}),
q_mine as materialized (select pid, k, sum((v = 0)::int) as bad, sum((v = 0 and kind = k)::int) as mine from q_long join q_own using (r), range({len(KINDS) + 1}) t(k) group by pid, k),
q_start as (select pid, k, case when k = 0 then case when bad > 1 then {START_GOOD[1]} else {START_GOOD[0]} end else case when bad > 1 then {START_FAULT[1]} else {START_FAULT[0]} end * mine end as w from q_mine),
q_w0 as materialized (select pid, k, w::double / sum(w) over (partition by pid) as w from q_start)"""
    ]
    for t in range(rounds):
        parts.append(f"q_t{t} as materialized (select k, sum(n * w) as t from q_w{t} join q_patterns using (pid) group by k)")
        parts.append(f"q_c{t} as materialized (select r, v, k, sum(n * w) as c from q_long join q_w{t} using (pid) group by r, v, k)")
        parts.append(f"""q_f{t} as materialized (select pid, k, sum(ln((c + x) / (t + whole))) + any_value(ln((t + 1) / ((select sum(t) from q_t{t}) + {len(KINDS) + 1})) + case when k > 0 and mine = 0 then {NEVER} else 0 end) as f
 from q_long join q_c{t} using (r, v) join q_added using (r, v, k) join q_t{t} using (k) join q_mine using (pid, k) group by pid, k)""")
        parts.append(f"q_w{t + 1} as materialized (select pid, k, exp(f - top) / sum(exp(f - top)) over (partition by pid) as w from (select *, max(f) over (partition by pid) as top from q_f{t}))")
    # the model of the last round is applied once more, to the documents
    t = rounds
    parts.append(f"q_t{t} as materialized (select k, sum(n * w) as t from q_w{t} join q_patterns using (pid) group by k)")
    parts.append(f"q_c{t} as materialized (select r, v, k, sum(n * w) as c from q_long join q_w{t} using (pid) group by r, v, k)")
    parts.append(f"""q_f{t} as materialized (select pid, k, sum(ln((c + x) / (t + whole))) + any_value(ln((t + 1) / ((select sum(t) from q_t{t}) + {len(KINDS) + 1})) + case when k > 0 and mine = 0 then {NEVER} else 0 end) as f
 from q_long join q_c{t} using (r, v) join q_added using (r, v, k) join q_t{t} using (k) join q_mine using (pid, k) group by pid, k)""")
    parts.append(f"q_good as materialized (select pid, 1 / sum(exp(f - good)) as g from (select *, max(f) filter (k = 0) over (partition by pid) as good from q_f{t}) group by pid)")
    parts.append(
        f"""judged as (select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
 not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and g >= {threshold} as kept from q_votes join q_patterns using ({", ".join(names)}) join q_good using (pid))"""
    )
    return ",\n".join(parts)
