"""Queries of the operators over the driver's tables, each with the SQL that states its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cues as cu
from ..functions import goals
from ..functions import outcome as oc
from ..functions import text as tx
from ..functions import vector as vec
from ..operators import clusters, judging, models, pairs, rubrics, scoring, sequences, tasks, traces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant,
           arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text, CAST(sum(length(text)) AS BIGINT) AS total_chars
    FROM conversations GROUP BY conv_id
""")
def traj_summary(spark, sf_dir):
    """Turns as steps: counts by role, the first and the last text (AGG-1, WIN-11)."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.min_by("text", "turn").alias("first_text"),
        F.max_by("text", "turn").alias("last_text"),
        F.sum(F.length("text")).cast("long").alias("total_chars"),
    )


@query("""
    WITH e AS (SELECT user_id, ts, event_id, event_type, event_type <> 'error' AS is_step,
                      CASE WHEN event_type = 'error' THEN props END AS msg,
                      CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n,
                      row_number() OVER w AS spot
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    p AS (SELECT *, greatest(n, 1) AS step FROM e),
    g AS (SELECT user_id, step, count(*) AS n_events, count(*) FILTER (NOT is_step) AS n_attached,
                 arg_max(msg, CASE WHEN is_step THEN 0 WHEN n = 0 THEN 1000000000000 ELSE 2000000000000 END + spot) FILTER (msg IS NOT NULL) AS last_error, bool_or(is_step) AS has
          FROM p GROUP BY user_id, step)
    SELECT user_id, step, n_events, n_attached, last_error FROM g WHERE has
""")
def step_assembly(spark, sf_dir):
    """Errors attach to the step before them, or wait for the first (WIN-1, CLS-1)."""
    kind = F.col("event_type")
    return sequences.assemble_steps(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], kind != "error", kind == "error", F.col("props"))


@query("""
    WITH e AS (SELECT user_id, event_type, event_id,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g
               FROM events)
    SELECT user_id, event_type, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n FROM e GROUP BY user_id, event_type, g HAVING count(*) >= 3
""")
def event_runs(spark, sf_dir):
    """Three and more equal events in a row (WIN-4)."""
    return sequences.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
    WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS place FROM events),
    f AS (SELECT event_id, user_id, place, last_value(place IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM e)
    SELECT event_id, user_id, place, previous, coalesce(place <> previous, false) AS changed FROM f
""")
def url_change_flag(spark, sf_dir):
    """Whether a value differs from the last one that is known (WIN-5)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("place"))
    return sequences.changed(e, "user_id", ["ts", "event_id"], "place").drop("ts")


@query("""
    WITH s AS (SELECT user_id, event_id, CAST(CASE WHEN event_type = 'error' THEN 8 ELSE 0 END + CASE WHEN event_type IN ('click', 'purchase') THEN 2 ELSE 0 END + CASE WHEN value > 50 THEN 4 ELSE 0 END AS INTEGER) AS score FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank_no FROM s)
    SELECT user_id, event_id, score, rank_no FROM r WHERE rank_no <= 5
""")
def transition_topk(spark, sf_dir):
    """The five best transitions of each user by an additive score (WIN-6, CARD-4)."""
    kind = F.col("event_type")
    score = F.when(kind == "error", 8).otherwise(0) + F.when(kind.isin("click", "purchase"), 2).otherwise(0) + F.when(F.col("value") > 50, 4).otherwise(0)
    return sequences.top_k(table(spark, sf_dir, "events"), "user_id", score, ["event_id"], 5).select("user_id", "event_id", "score", "rank_no")


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents),
    c AS (SELECT doc_id, spot, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS x FROM l),
    k AS (SELECT doc_id, CASE WHEN length(x) <= 220 THEN x ELSE rtrim(substring(x, 1, 202)) || ' ...[truncated]' END AS x, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS pos FROM c WHERE x <> ''),
    f AS (SELECT doc_id, pos, CASE WHEN pos = 1 AND length(x) > 100 THEN rtrim(substring(x, 1, 82)) || ' ...[truncated]' ELSE x END AS line FROM k),
    s AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM f)
    SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest
    FROM s WHERE pos = 1 OR upto <= 100 GROUP BY doc_id
""")
def line_budget_fit(spark, sf_dir):
    """Trimmed lines until the first that overflows a budget, always the first one (WIN-8)."""
    kept = table(spark, sf_dir, "documents").select("doc_id", sequences.fit_budget(tx.clean_lines(F.col("text")), 100).alias("kept")).where(F.size("kept") > 0)
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_lines"), F.aggregate("kept", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("n_chars"), F.md5(F.array_join("kept", "\n")).alias("digest"))


@query("""
    SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE rtrim(substring(t, 1, 180)) || ' ...[truncated]' END AS line
    FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
""")
def norm_ws_trim(spark, sf_dir):
    """One-line trim with a mark (STR-2)."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.one_line(F.col("text"), 200).alias("line"))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents),
    k AS (SELECT doc_id, trim(line) AS line, spot FROM l WHERE trim(line) <> ''),
    f AS (SELECT doc_id, lower(line) AS low, arg_min(line, spot) AS line, min(spot) AS spot FROM k GROUP BY doc_id, lower(line))
    SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY spot)) AS digest FROM f GROUP BY doc_id
""")
def ordered_dedupe_lines(spark, sf_dir):
    """Lines without repeats, whatever their case, in order (AGG-24)."""
    kept = table(spark, sf_dir, "documents").select("doc_id", tx.ordered_distinct(F.split("text", "\n")).alias("kept")).where(F.size("kept") > 0)
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_lines"), F.md5(F.array_join("kept", "\n")).alias("digest"))


@query("""
    SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[. ]+$', ''), ''), 'unknown') AS file_name,
           substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS slug
    FROM pages
""")
def safe_path_part(spark, sf_dir):
    """URLs as file names and slugs (SNK-9, PRJ-13)."""
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_path_part(F.col("url")).alias("file_name"), tx.slug(F.col("url")).alias("slug"))


@query("""
    SELECT page_id, string_split(url, '/')[3] AS domain, string_split(url, '/')[4] AS model, regexp_replace(string_split(string_split(url, '/')[-1], '?')[1], '\\.[^.]*$', '') AS job
    FROM pages WHERE len(string_split(url, '/')) >= 4
""")
def path_columns(spark, sf_dir):
    """Columns from the parts of a path (SRC-13, SRC-17)."""
    parts = F.split("url", "/")
    job = F.regexp_replace(F.get(F.split(F.element_at(parts, -1), r"\?"), F.lit(0)), r"\.[^.]*$", "")
    return table(spark, sf_dir, "pages").where(F.size(parts) >= 4).select("page_id", F.get(parts, F.lit(2)).alias("domain"), F.get(parts, F.lit(3)).alias("model"), job.alias("job"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query(f"""
    WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents),
    c AS (SELECT lang, token, count(*) AS n FROM t WHERE token NOT IN ({_STOP}) GROUP BY lang, token),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank_no FROM c)
    SELECT lang, token, n, rank_no FROM r WHERE rank_no <= 8
""")
def top_keywords(spark, sf_dir):
    """The eight most frequent tokens of each language (STR-3, AGG-22)."""
    counts = table(spark, sf_dir, "documents").select("lang", F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank_no", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token")).cast("long"))
    return ranked.where("rank_no <= 8")


@query("""
    WITH c AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w, lag(list_distinct(string_split(lower(text), ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
    SELECT conv_id, turn, round(CAST(len(list_intersect(w, p)) AS DOUBLE) / least(len(w), len(p)), 6) AS overlap,
           round(CAST(len(list_intersect(w, p)) AS DOUBLE) / (len(w) + len(p) - len(list_intersect(w, p))), 6) AS jaccard
    FROM c WHERE p IS NOT NULL
""")
def literal_overlap(spark, sf_dir):
    """Common words of neighbouring turns (MTH-2, SET-3)."""
    w = F.array_distinct(F.split(F.lower("text"), " "))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w"))
    c = c.withColumn("p", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p IS NOT NULL")
    same = F.size(F.array_intersect("w", "p"))
    return c.select("conv_id", "turn", F.round(tx.overlap(F.col("w"), F.col("p")), 6).alias("overlap"), F.round(same / F.size(F.array_union("w", "p")), 6).alias("jaccard"))


@query("""
    WITH t AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS w FROM conversations),
    c AS (SELECT conv_id, turn, w, count(*) AS n FROM t GROUP BY ALL),
    q AS (SELECT conv_id, turn, sum(n * n) AS s FROM c GROUP BY ALL),
    d AS (SELECT a.conv_id, b.turn, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.w = b.w AND b.turn = a.turn + 1 GROUP BY ALL)
    SELECT y.conv_id, y.turn, round(coalesce(CAST(dot AS DOUBLE), 0) / (sqrt(CAST(x.s AS DOUBLE)) * sqrt(CAST(y.s AS DOUBLE))), 6) AS cosine
    FROM q x JOIN q y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 LEFT JOIN d ON d.conv_id = y.conv_id AND d.turn = y.turn
""")
def bow_cosine(spark, sf_dir):
    """Cosine of word counts of neighbouring turns (MTH-1)."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    c = words.groupBy("conv_id", "turn", "w").agg(F.count("*").alias("n"))
    q = c.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "w", F.col("n").alias("m"))
    d = c.join(nxt, ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    after = q.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("norm").alias("norm2"))
    both = q.join(after, ["conv_id", "turn"]).join(d, ["conv_id", "turn"], "left")
    return both.select("conv_id", (F.col("turn") + 1).alias("turn"), F.round(F.coalesce("dot", F.lit(0)) / (F.col("norm") * F.col("norm2")), 6).alias("cosine"))


_TERMS = ["error", "the", "token", "license"]


@query("""
    WITH t AS (SELECT doc_id, lower(text) AS low FROM documents)
    SELECT doc_id, concat_ws(',', CASE WHEN contains(low, 'error') THEN 'error' END, CASE WHEN contains(low, 'the') THEN 'the' END, CASE WHEN contains(low, 'token') THEN 'token' END, CASE WHEN contains(low, 'license') THEN 'license' END) AS terms FROM t
""")
def matched_terms(spark, sf_dir):
    """Terms that a text holds (STR-6)."""
    terms = F.array(*map(F.lit, _TERMS))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.matched_terms(terms, F.col("text")), ",").alias("terms"))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents),
    c AS (SELECT doc_id, spot, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM l),
    s AS (SELECT doc_id, spot, CASE WHEN length(line) <= 360 THEN line ELSE rtrim(substring(line, 1, 320)) || chr(10) || '...[truncated]...' END AS line,
                 10 * len(list_filter(['token', 'license'], lambda t: contains(lower(line), t)))
                 + len(list_filter(['heading', 'statictext', 'grid', 'table', 'region', 'link', 'button', 'searchbox', 'textbox', 'combobox', 'alert', 'error'], lambda t: contains(lower(line), t))) AS score FROM c WHERE line <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, spot) AS k FROM s WHERE score > 0 OR spot <= 4)
    SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY k)) AS digest, count(*) AS n FROM r WHERE k <= 6 GROUP BY doc_id
""")
def evidence_rank_docs(spark, sf_dir):
    """Lines ranked by matched terms and the twelve roles (TOP-2)."""
    best = cu.ranked_evidence(tx.split_lines(F.col("text")), F.array(F.lit("token"), F.lit("license")), 6)
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).where(F.size("b") > 0).select("doc_id", F.md5(F.array_join("b", "\n")).alias("digest"), F.size("b").cast("long").alias("n"))


_LABELS = ["Successful", "unsuccessful", "Passed", "FAILED", "wrong", "succeeded", "correct", "incorrect", "an error", "1", "0", "yes", "N", "true", "0.7", "", "maybe", "critical", "Important", "small", "optional", "severe", " Low "]


@query("""
    WITH o AS (SELECT o_orderkey, o_totalprice, ['Successful', 'unsuccessful', 'Passed', 'FAILED', 'wrong', 'succeeded', 'correct', 'incorrect', 'an error', '1', '0', 'yes', 'N', 'true', '0.7', '', 'maybe', 'critical', 'Important', 'small', 'optional', 'severe', ' Low '][o_orderkey % 23 + 1] AS w FROM orders),
    t AS (SELECT *, lower(w) AS low, lower(trim(w)) AS word, CASE WHEN regexp_matches(lower(w), 'fail|failed|error|incorrect|wrong') THEN 'failure' WHEN regexp_matches(lower(w), 'success|succeed|pass|passed|correct') THEN 'success' END AS by_words FROM o),
    p AS (SELECT *, CASE WHEN word IN ('success', 'succeeded', 'pass', 'passed', 'correct') THEN 'success' WHEN word IN ('failure', 'failed', 'fail', 'incorrect', 'wrong', 'error') THEN 'failure' END AS exact FROM t)
    SELECT o_orderkey,
      coalesce(by_words, CASE WHEN o_totalprice / 400000 >= 0.5 THEN 'success' ELSE 'failure' END) AS generic,
      CASE WHEN word IN ('1', 'true', 'yes', 'y') THEN 'success' WHEN word IN ('0', 'false', 'no', 'n') THEN 'failure' ELSE coalesce(by_words, 'unknown') END AS normalised,
      coalesce(exact, CASE WHEN o_totalprice - 150000 > 0 THEN 'success' ELSE 'failure' END) AS of_pair,
      coalesce(nullif(trim(w), ''), CASE WHEN o_totalprice - 150000 > 0 THEN 'success' ELSE 'failure' END) AS of_sample,
      CASE exact WHEN 'success' THEN 1 WHEN 'failure' THEN 0 END AS label,
      CASE WHEN word IN ('high', 'critical', 'severe', 'major', 'important') THEN 'high' WHEN word IN ('low', 'minor', 'small', 'optional') THEN 'low' ELSE 'medium' END AS severity,
      CASE WHEN low IN ('high', 'critical', 'major', 'important') THEN 'high' WHEN low IN ('low', 'minor', 'optional') THEN 'low' ELSE 'medium' END AS bank_severity
    FROM p
""")
def outcome_rules(spark, sf_dir):
    """The outcome rules and both severity rules over words that tell them apart (OUT-1, OUT-2, OUT-4 to OUT-6, CLS-3)."""
    w, price = F.col("w"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.get(F.array(*map(F.lit, _LABELS)), (F.col("o_orderkey") % 23).cast("int")).alias("w"))
    return rows.select(
        "o_orderkey", oc.outcome_by_words(w, score=price / 400000).alias("generic"), oc.outcome_normalised(w).alias("normalised"), oc.outcome_of_pair(w, reward=price - 150000).alias("of_pair"),
        oc.outcome_of_sample(w, price - 150000).alias("of_sample"), oc.label_of(oc.outcome_word(w)).alias("label"), oc.severity(w).alias("severity"), oc.severity(w, bank=True).alias("bank_severity"),
    )


_ORDERS = "(SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' ELSE 'unknown' END AS outcome FROM orders)"


def _candidates(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(status == "F", oc.SUCCESS).when(status == "O", oc.FAILURE).otherwise(oc.UNKNOWN).alias("outcome"))


@query(f"""
    SELECT o_custkey, count(*) AS candidate_count, count(*) FILTER (outcome = 'success') AS n_success, count(*) FILTER (outcome = 'failure') AS n_failure, count(*) FILTER (outcome = 'unknown') AS n_unknown,
           CASE WHEN count(*) FILTER (outcome = 'success') > 0 AND count(*) FILTER (outcome = 'failure') > 0 THEN NULL WHEN count(*) FILTER (outcome = 'success') > 0 THEN 'all_success' WHEN count(*) FILTER (outcome = 'failure') > 0 THEN 'all_failure' ELSE 'no_success_or_failure' END AS skip_reason
    FROM {_ORDERS} GROUP BY o_custkey
""")
def pair_report(spark, sf_dir):
    """Outcome counts of each group, and why it gives no pair (AGG-2, CLS-4)."""
    return pairs.group_counts(_candidates(spark, sf_dir), ["o_custkey"])


@query(f"""
    SELECT o_custkey, min(o_orderkey) FILTER (outcome = 'success') AS positive, min(o_orderkey) FILTER (outcome = 'failure') AS negative
    FROM {_ORDERS} GROUP BY o_custkey HAVING count(*) FILTER (outcome = 'success') > 0 AND count(*) FILTER (outcome = 'failure') > 0
""")
def pair_pick(spark, sf_dir):
    """The first success and failure of each group (AGG-2)."""
    return pairs.pick_first_pairs(_candidates(spark, sf_dir), ["o_custkey"], "o_orderkey")


@query()
def pair_sample(spark, sf_dir):
    """A success and a failure of each group by a seeded hash (SMP-1)."""
    return pairs.pick_pairs(_candidates(spark, sf_dir), ["o_custkey"], "o_orderkey")


@query(f"""
    WITH g AS (SELECT o_custkey, count(*) FILTER (outcome = 'success') AS s, count(*) FILTER (outcome = 'failure') AS f FROM {_ORDERS} GROUP BY o_custkey)
    SELECT CASE WHEN s > 0 AND f > 0 THEN 'paired' WHEN s > 0 THEN 'all_success' WHEN f > 0 THEN 'all_failure' ELSE 'no_success_or_failure' END AS state, count(*) AS n_groups, CAST(sum(s) AS BIGINT) AS n_success, CAST(sum(f) AS BIGINT) AS n_failure FROM g GROUP BY 1
""")
def pair_summary(spark, sf_dir):
    """Groups by skip reason (AGG-4)."""
    g = pairs.group_counts(_candidates(spark, sf_dir), ["o_custkey"]).withColumn("state", F.coalesce("skip_reason", F.lit("paired")))
    return g.groupBy("state").agg(F.count("*").alias("n_groups"), F.sum("n_success").alias("n_success"), F.sum("n_failure").alias("n_failure"))


@query("""
    WITH r AS (SELECT lang, quality, doc_id, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS rank_no FROM documents JOIN labels USING (doc_id))
    SELECT * FROM r WHERE rank_no <= 5
""")
def stratified_sample(spark, sf_dir):
    """Five documents of each language and quality (SMP-2)."""
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return pairs.stratified(both, ["lang", "quality"], ["doc_id"], 5)


@query("""
    WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1 AS f FROM orders),
    b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, f ORDER BY o_orderkey) AS up, row_number() OVER (PARTITION BY o_custkey, f ORDER BY o_orderkey DESC) AS down, 6 - sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS rest FROM a)
    SELECT o_custkey, o_orderkey, o_orderstatus FROM b WHERE f OR up <= ceil(rest / 2) OR down <= floor(rest / 2)
""")
def head_tail_sample(spark, sf_dir):
    """One of each outcome, then head and tail up to six (SMP-3)."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return pairs.head_tail_sample(rows, "o_custkey", "o_orderstatus", ["o_orderkey"], 6)


@query("""
    WITH v AS (SELECT l_partkey, CASE l_returnflag WHEN 'R' THEN 'Unsuccessful' WHEN 'A' THEN 'Successful' ELSE 'Unsure' END AS vote FROM lineitem),
    g AS (SELECT l_partkey, count(*) FILTER (vote = 'Successful') AS n_success, count(*) FILTER (vote = 'Unsuccessful') AS n_failure FROM v GROUP BY l_partkey)
    SELECT l_partkey, n_success, n_failure, CASE WHEN n_success + n_failure > 0 THEN CASE WHEN n_success >= n_failure THEN 'success' ELSE 'failure' END ELSE 'unknown' END AS outcome FROM g
""")
def annotation_votes(spark, sf_dir):
    """Votes in words, and the outcome that they give (AGG-3, OUT-3)."""
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(flag == "R", "Unsuccessful").when(flag == "A", "Successful").otherwise("Unsure").alias("vote"))
    v = pairs.votes(rows, ["l_partkey"], "vote")
    return v.withColumn("outcome", oc.outcome_by_votes(F.col("n_success"), F.col("n_failure"), F.lit(None).cast("double"), F.lit(False)))


@query("""
    SELECT s.s_suppkey, coalesce(a.c_name, b.c_name, c.c_name) AS c_name FROM supplier s
    LEFT JOIN customer a ON a.c_custkey = s.s_suppkey * 1000 LEFT JOIN customer b ON b.c_custkey = s.s_suppkey * 20 LEFT JOIN customer c ON c.c_custkey = s.s_suppkey
""")
def multi_key_lookup(spark, sf_dir):
    """The first of several candidate keys that a lookup has (JN-2)."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    lookup = table(spark, sf_dir, "customer")
    return pairs.first_match(s, F.array(key * 1000, key * 20, key), lookup, "c_custkey", "c_name", "s_suppkey")


@query("""
    SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey
""")
def latest_wins_upsert(spark, sf_dir):
    """The latest row of each key (SNK-3, SET-7)."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return pairs.latest_wins(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf_dir):
    """Rows without a result yet (FLT-4, SET-4)."""
    return pairs.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS n_found, CAST(count(*) - count(l.doc_id) AS BIGINT) AS n_missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def missing_keys(spark, sf_dir):
    """Keys that a left join misses, by group (JN-5)."""
    found = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("found"))
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(found, "doc_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count("found").alias("n_found"), F.count_if(F.col("found").isNull()).alias("n_missing"))


_VEC = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"""
    SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM {_VEC} a JOIN {_VEC} b ON a.vec_id < b.vec_id WHERE 1 - list_cosine_similarity(a.v, b.v) <= 0.7
""")
def cosine_pairs(spark, sf_dir):
    """Pairs within a cosine distance, by block products (MTH-7, MTH-8, JN-13)."""
    return vec.pair_distances(_vectors(spark, sf_dir), 0.7).withColumn("distance", F.round("distance", 6))


_WEIGHTS = f"""
    WITH d AS (SELECT q.vec_id AS a, r.vec_id AS b, 1 - list_cosine_similarity(q.v, r.v) AS d FROM {_VEC} q JOIN {_VEC} r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
    e AS (SELECT a, b, exp((min(d) OVER (PARTITION BY a) - d) / 0.05) AS e FROM d),
    w AS (SELECT a, b, e / sum(e) OVER (PARTITION BY a) AS weight FROM e)
"""


def _weights(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    d = vec.query_distances(rows.where(F.col("id") % 100 == 0), rows)  # the query set of searches: ids divisible by 100
    return vec.with_softmax(d, "distance", ["a"], 0.05, "weight").select("a", "b", "weight")


@query(_WEIGHTS + "SELECT a, b, round(weight, 6) AS weight FROM w")
def softmax_applicability(spark, sf_dir):
    """Weights of all rows for each query (JN-12, MTH-9)."""
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(_WEIGHTS + ", r AS (SELECT a, b, weight, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rank_no FROM w) SELECT a, b, round(weight, 6) AS weight, rank_no, CAST(floor((rank_no - 1) / 8) AS BIGINT) AS chunk FROM r WHERE rank_no <= 32")
def applicability_topk(spark, sf_dir):
    """The 32 heaviest of each query, in chunks of eight (TOP-9, WIN-14)."""
    top = sequences.top_k(_weights(spark, sf_dir), "a", F.col("weight"), ["b"], 32)
    chunked = sequences.chunk_number(top, "a", ["rank_no"], 8)
    return chunked.select("a", "b", F.round("weight", 6).alias("weight"), "rank_no", "chunk")


@query(_WEIGHTS + """, s AS (SELECT a, sum(weight * CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END) AS first, sum(weight * CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END) AS second FROM w JOIN embeddings ON vec_id = b GROUP BY a),
    m AS (SELECT first - second AS margin FROM s)
    SELECT count(*) AS completed, count(*) FILTER (margin > 0) AS correct, count(*) FILTER (margin = 0) AS ties, round(CAST(count(*) FILTER (margin > 0) AS DOUBLE) / count(*), 6) AS accuracy, round(avg(margin), 6) AS mean_margin FROM m
""")
def pair_accuracy(spark, sf_dir):
    """Weighted scores of two responses, margins and accuracy (AGG-11, AGG-12, AGG-23)."""
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("b"), "label")
    w = _weights(spark, sf_dir).join(label, "b")
    totals = w.groupBy("a").agg(F.sum(F.col("weight") * F.when(F.col("label") >= 5, 1.0).otherwise(0.0)).alias("first"), F.sum(F.col("weight") * F.when(F.col("label") < 5, 1.0).otherwise(0.0)).alias("second"))
    long = totals.select("a", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("first").alias("s")), F.struct(F.lit(1).alias("i"), F.col("second").alias("s")))).alias("x")).select("a", "x.i", "x.s")
    out = scoring.accuracy(scoring.margins(long, "a", "i", "s"))
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("mean_margin", F.round("mean_margin", 6))


@query("""
    WITH r AS (SELECT l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id)),
    k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM r)
    SELECT count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y = 0) AS n_negative,
           round(CAST((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS DOUBLE), 6) AS auc FROM k
""")
def auc_global(spark, sf_dir):
    """AUC by average ranks, without a pair join (AGG-14, JN-14)."""
    return scoring.auc(_labelled(spark, sf_dir), "quality", "n_chars").withColumn("auc", F.round("auc", 6))


@query("""
    WITH r AS (SELECT d.lang, l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id)),
    k AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS k FROM r)
    SELECT lang, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y = 0) AS n_negative,
           round(CAST((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS DOUBLE), 6) AS auc FROM k GROUP BY lang
""")
def auc_by_group(spark, sf_dir):
    """AUC of each group (AGG-14, AGG-15)."""
    return scoring.auc(_labelled(spark, sf_dir), "quality", "n_chars", ["lang"]).withColumn("auc", F.round("auc", 6))


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query("""
    SELECT lang, round(avg(n_chars) FILTER (quality = 1), 4) AS mean_positive, round(avg(n_chars) FILTER (quality = 0), 4) AS mean_negative, count(*) AS n,
           round(avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0), 4) AS gap FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def class_gap(spark, sf_dir):
    """Class means and their gap (AGG-15)."""
    out = scoring.class_means(_labelled(spark, sf_dir), "quality", "n_chars", ["lang"])
    return out.select("lang", F.round("mean_positive", 4).alias("mean_positive"), F.round("mean_negative", 4).alias("mean_negative"), "n", F.round("gap", 4).alias("gap"))


@query("""
    SELECT l_suppkey, round(sum(l_discount * w) / sum(w), 6) AS score FROM (SELECT l_suppkey, l_discount, CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS w FROM lineitem) GROUP BY l_suppkey
""")
def weighted_severity_mean(spark, sf_dir):
    """A mean weighted by severity (AGG-10)."""
    flag = F.col("l_returnflag")
    weight = oc.severity_weight(F.when(flag == "R", "high").when(flag == "A", "low").otherwise("medium"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(scoring.weighted_mean(F.col("l_discount"), weight), 6).alias("score"))


@query("""
    WITH p AS (SELECT p_brand, p_partkey, p_size, lower(trim(p_type)) AS d, p_size % 5 = 0 AS leaks FROM part),
    t AS (SELECT p_brand, d, count(*) AS n, min(p_partkey) AS spot FROM p GROUP BY p_brand, d),
    w AS (SELECT p_brand, string_agg(d, ',' ORDER BY spot) FILTER (n > 1) AS twice FROM t GROUP BY p_brand),
    g AS (SELECT p_brand, count(*) AS n, max(p_size) AS size, count(*) FILTER (leaks) AS hits, count(*) FILTER (p_size % 3 = 0) AS told FROM p GROUP BY p_brand)
    SELECT p_brand AS cluster_id, n AS rubric_count, concat_ws(',', CASE WHEN twice IS NOT NULL THEN 'duplicate_dimensions' END, CASE WHEN n < 3 THEN 'too_few_rubrics' END, CASE WHEN n > 6 THEN 'too_many_rubrics' END, CASE WHEN size % 2 = 0 THEN 'singleton_cluster' END, CASE WHEN hits > 0 THEN 'instance_leakage' END) AS flags,
           md5(coalesce(twice, '')) AS twice, least(hits, 20) AS listed, round(told::DOUBLE / n, 6) AS told_share
    FROM g JOIN w USING (p_brand)
""")
def static_audit(spark, sf_dir):
    """Flags of groups of criteria: repeated dimensions, few and many criteria, single members, identifiers; coverage of fields (AGG-16, AGG-17, FLT-11)."""
    none = F.array().cast("array<string>")
    evidence = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("seen"))).otherwise(none)
    criterion = F.when(F.col("p_size") % 5 == 0, "see https://a.example/x").otherwise("plain")
    r = F.struct(F.col("p_type").alias("dimension"), criterion.alias("criterion"), evidence.alias("positive_evidence"), none.alias("negative_evidence"), F.lit("low").alias("severity"), F.lit("").alias("verification_guide"))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cluster_id")).agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", r.alias("r")))).alias("x"), F.when(F.max("p_size") % 2 == 0, 1).otherwise(2).alias("cluster_size")
    )
    got = judging.static_audit(rows.withColumn("rubrics", F.transform("x", lambda x: x["r"])))
    twice = F.array_join(F.flatten(F.transform("flags", lambda f: f["values"])), ",")
    return got.select("cluster_id", "rubric_count", F.array_join(F.transform("flags", lambda f: f["type"]), ",").alias("flags"), F.md5(twice).alias("twice"), F.size("leakage_hits").cast("long").alias("listed"), F.round("field_coverage.positive_evidence", 6).alias("told_share"))


@query("""
    SELECT doc_id, len(regexp_extract_all(text, '(?i)#?[0-9a-f]{6,}-[0-9a-f]?')) AS n_uuid_or_series_id, len(regexp_extract_all(text, '\\b(?:RITM|INC|PRB|CHG|EXP)\\d{4,}\\b')) AS n_record_number,
           len(regexp_extract_all(text, 'https?://|\\.do\\b|/now/nav|/catalogsearch')) AS n_literal_url_or_path, len(regexp_extract_all(text, '(?:click|fill|select_option|upload_file)\\(''[A-Za-z0-9_]+''')) AS n_literal_action_id,
           len(regexp_extract_all(text, '\\b[A-Z][a-z]+-[A-Z][a-z]+\\s+[A-Z][a-z]+-[A-Z][a-z]+\\b')) AS n_hyphenated_person_name FROM documents
""")
def leakage_hits(spark, sf_dir):
    """Identifiers in texts, by kind (FLT-11)."""
    return table(spark, sf_dir, "documents").select("doc_id", *scoring.leak_counts(F.col("text")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_json(spark, sf_dir):
    """A typed value of open JSON (PRJ-6, JSN-6)."""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'view') AS n_view,
           array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, md5(string_agg(event_type, '>' ORDER BY ts, event_id)) AS signature FROM events GROUP BY user_id
""")
def events_type_features(spark, sf_dir):
    """Type counts, distinct types and a signature of the sequence (AGG-21)."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    in_order = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        n("click").alias("n_click"), n("error").alias("n_error"), n("view").alias("n_view"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
        F.md5(F.array_join(F.transform(in_order, lambda x: x["event_type"]), ">")).alias("signature"),
    )


@query("""
    WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 3 WHEN 'click' THEN 6 ELSE 7 END AS priority FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, event_id) AS spot FROM p)
    SELECT user_id, event_id, priority, CAST(floor((spot - 1) / 32) AS BIGINT) AS chunk FROM r
""")
def card_priority_sort(spark, sf_dir):
    """Cards in order of priority, in chunks of 32 (CLS-5, TOP-8, WIN-14)."""
    kind = F.col("event_type")
    name = F.when(kind == "purchase", "Task_Context").when(kind == "error", "x").when(kind == "click", "evidence_observation_2")
    role = F.when(kind == "error", "negative_or_side_effect_evidence")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", oc.card_priority(name, role).alias("priority"))
    return sequences.chunk_number(rows, "user_id", ["priority", "event_id"], 32)


@query("SELECT doc_id, 'doc:' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ':' || substring(sha1(text), 1, 12) AS stable_id FROM documents")
def stable_id(spark, sf_dir):
    """An identifier from a number and a digest (PRJ-14, STR-24)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(":"), F.substring(F.sha1(F.encode("text", "UTF-8")), 1, 12)).alias("stable_id"))


@query("""
    SELECT lang, CAST(to_json(map_from_entries(list((source, n) ORDER BY source))) AS VARCHAR) AS sources FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang
""")
def ordered_counts(spark, sf_dir):
    """A map of counts in order of keys (AGG-6, JSN-5)."""
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.to_json(tx.counts_map(F.col("source"), F.col("n"))).alias("sources"))


_EDGES = f"(SELECT a.vec_id AS a, b.vec_id AS b FROM {_VEC} a JOIN {_VEC} b ON a.vec_id <> b.vec_id WHERE 1 - list_cosine_similarity(a.v, b.v) <= 0.6)"


@query(f"""
    WITH RECURSIVE edges AS MATERIALIZED (SELECT * FROM {_EDGES}),
    reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a)
    SELECT id, min(other) AS component FROM reach GROUP BY id
""")
def threshold_components(spark, sf_dir):
    """Components of pairs within a distance (step 2 of the linkage)."""
    rows = _vectors(spark, sf_dir)
    return clusters.components(vec.pair_distances(rows, 0.6), rows)


@query()
def cluster_labels(spark, sf_dir):
    """Clusters by consensus of average linkages (MTH-11, AGG-18 to AGG-20, WIN-12, WIN-13)."""
    return clusters.cluster_tasks(_vectors(spark, sf_dir), thresholds=(0.5, 0.55, 0.6)).drop("labels")


@query()
def cluster_summary(spark, sf_dir):
    """Sizes and strength of clusters (AGG-5)."""
    return clusters.cluster_summary(clusters.cluster_tasks(_vectors(spark, sf_dir), thresholds=(0.5, 0.55, 0.6)))


@query()
def mcr_selection(spark, sf_dir):
    """A subset of each group by coding rate (TOP-12, MTH-12 to MTH-14)."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rubrics.mcr_selection(rows, "label", most=10)


@query()
def model_output_repair(spark, sf_dir):
    """Criteria from a stub model's answers on each item (SRC-27, JSN-1, PRJ-28, PRJ-35)."""
    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("pair_id"), F.concat(F.lit("Name criteria for:\n"), "text").alias("prompt"))
    answers = models.complete_all(prompts, models.StubClient, "pair_id")
    return rubrics.flatten(rubrics.parse_rubrics(answers), "pair_id", "rubrics").select("pair_id", "rubric_id", "dimension", "criterion", "severity")


@query()
def conversation_summaries(spark, sf_dir):
    """Conversations as traces: steps, actions, final state, errors and cards (PRJ-17 to PRJ-19, CARD-1)."""
    turns = table(spark, sf_dir, "conversations")
    event = F.when(F.col("role") == "assistant", F.struct(F.col("turn").alias("num"), F.col("text").alias("thought"), F.lit(None).cast("string").alias("observation"))).otherwise(
        F.struct(F.col("turn").alias("num"), F.lit(None).cast("string").alias("thought"), F.col("text").alias("observation"))
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))).alias("x"), F.min_by("text", "turn").alias("task"))
    as_variant = F.transform("x", lambda x: F.parse_json(F.to_json(x["e"])))
    records = grouped.select(F.col("conv_id").cast("string").alias("record_id"), "task", F.lit(oc.UNKNOWN).alias("outcome"), as_variant.alias("trace"), F.create_map().cast("map<string,variant>").alias("metadata"), F.lit(None).cast("variant").alias("chat_messages"), F.lit(None).cast("string").alias("load_error"), F.lit("").alias("source_path"))
    return traces.summaries(records).select("record_id", "outcome", "n_steps", F.size("cards").alias("n_cards"), F.size("final_state.evidence_lines").alias("n_final_lines"))


@query("""
    SELECT p_partkey, 'workarena:' || p_brand || ':' || array_to_string(string_split(lower(replace(p_type, ' ', '-')), '-')[1:3], '-') AS family,
           CASE WHEN p_size % 2 = 0 THEN 'webarena:' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || ':unknown_eval' ELSE 'webarena.' || p_size END AS site_family
    FROM part
""")
def task_family(spark, sf_dir):
    """Families of tasks by the fields of their benchmark, else by their names (PRJ-10, PRJ-11)."""
    name = F.lower(F.regexp_replace("p_type", " ", "-"))
    action = tasks.task_family(F.lit("workarena"), name, {"category": F.col("p_brand")})
    site = tasks.task_family(F.lit("webarena"), F.concat(F.lit("webarena.resized."), F.col("p_size"), F.lit(".7")), {"sites": F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))})
    return table(spark, sf_dir, "part").select("p_partkey", action.alias("family"), site.alias("site_family"))


@query()
def goal_terms(spark, sf_dir):
    """Terms of each item's wording, for ranking only (STR-4)."""
    return table(spark, sf_dir, "benchmark").select("item_id", goals.goal_terms(F.col("text")).alias("terms"))


def _steps_written_and_read(turns):
    line = F.concat_ws("\n", F.concat(F.lit("Step: "), "turn"), F.concat(F.lit("Action: "), "role", F.lit("()")), F.when(F.col("role") == "assistant", F.concat(F.lit("Reasoning: "), "text")), F.lit("-----"))
    written = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return traces.steps_of_text(written, "conv_id").select("conv_id", F.col("step_index").alias("turn"), "thought", "action")


@query()
def text_steps(spark, sf_dir):
    """All turns of conversations written as lines of steps, and read back: joined lines and trims too, which no SQL here states (WIN-10)."""
    return _steps_written_and_read(table(spark, sf_dir, "conversations"))
