"""Model output to criteria: repair, normalisation, merging groups, selection by coding rate."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.outcome import HIGH, LOW
from ..functions.text import counts_by_size, one_line, strip
from ..session import ship

# Names under which a list of criteria or a field of one may come, in order of priority.
LIST_KEYS = ("rubrics", "rubric_items", "items", "criteria", "evaluation_criteria", "signals", "discriminative_signals", "data")
CRITERION = ("criterion", "criteria", "description", "rubric", "rule", "requirement", "evaluation_criterion", "success_criterion", "check", "observable_criterion")
DIMENSION = ("dimension", "category", "capability", "name", "title", "failure_mode")
POSITIVE = ("positive_evidence", "positive", "success_evidence", "positive_examples", "strong_evidence", "what_strong_trajectories_do")
NEGATIVE = ("negative_evidence", "negative", "failure_evidence", "negative_examples", "weak_evidence", "what_weak_trajectories_do")
SEVERITY = ("severity", "importance", "priority")
RATIONALE = ("rationale", "reason", "why", "justification")
GUIDE = ("verification_guide", "verification", "verification_protocol", "how_to_verify")
# Names of evidence in an object of its own, of a guide's lists and texts, and of merged criteria.
OF_EVIDENCE = {"positive_evidence": ("positive", "positive_evidence", "success"), "negative_evidence": ("negative", "negative_evidence", "failure")}
GUIDE_LISTS = {
    "what_to_extract": ("what_to_extract", "what_to_look_for", "variables", "evidence_to_extract", "signals_to_inspect"),
    "checks": ("checks", "verification_steps", "verification_checks", "method_steps", "how_to_check"),
}
GUIDE_TEXTS = {"evidence_pattern": ("evidence_pattern", "example_pattern", "pattern", "observable_pattern"), "verification_method": ("verification_method", "method", "verifier")}
THEME = ("theme", "dimension", "category", "title", "criterion", "criteria", "rubric", "description")
TIPS = ("tips", "guidance", "checks", "criteria", "rubrics", "items", "requirements", "evaluation_points")
TIP = ("criterion", "criteria", "rubric", "description")
MERGED_LISTS, NESTED_LISTS = ("categories", "rubrics", "rubric_items", "items", "criteria"), ("categories", "rubrics", "items")
SOURCES, NAMES_ONLY = ("source_pair_ids", "pair_ids", "sources"), ("record_", "task_cluster_", "cluster_", "rubric_")
# Fields whose opening brace a model may leave out, and fields that speak for a list of criteria.
UNBRACED = "dimension|criterion|criteria|category|capability|requirement|evaluation_criterion"
TELLING = {"dimension", "criterion", "criteria", "description", "rubric", "rule", "requirement", "evaluation_criterion", "success_criterion", "check"}
DEFAULT_DIMENSION = "trajectory_quality"
ITEM = "dimension string, criterion string, positive_evidence array<string>, negative_evidence array<string>, severity string, rationale string, verification_guide string"


def _unfenced(text: str | None) -> str:
    t = (text or "").strip()
    inside = re.search(r"```(?:json)?\s*(.*?)\s*```", t, re.S | re.I)
    return inside[1].strip() if inside else t


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _embedded(text: str, openings: str) -> Iterator:
    """What can be read from each opening bracket of a text."""
    for m in re.finditer(openings, text):
        try:
            yield json.JSONDecoder().raw_decode(text, m.start())[0]
        except ValueError:
            continue


def _list_score(items: list) -> int:
    """10 for an object and 1 for each telling field; lists inside count by what they hold, less 5."""
    of = lambda x: 10 + len(TELLING & x.keys()) if isinstance(x, dict) else max(0, _list_score(x) - 5) if isinstance(x, list) else 0
    return sum(map(of, items))


def extract_array(text: str | None) -> list:
    """The JSON list in a model's answer: fenced, wrapped in an object, with missing braces, or inside prose.

    The best of several lists counts, the first of equals. Without any, ValueError.
    """
    plain = _unfenced(text)
    braced = re.sub(rf'}}\s*,\s*"({UNBRACED})"\s*:', r'},{"\1":', plain.replace("\\'", "'"))
    tries = [plain, braced, re.sub(r"}(\s*\]\s*)$", r"\1", braced)]
    for t in tries:
        got = _json(t)
        if isinstance(got, dict):
            got = next((got[k] for k in LIST_KEYS if isinstance(got.get(k), list)), None)
        if isinstance(got, list):
            return got
    found = [x for t in tries for x in _embedded(t, r"\[") if isinstance(x, list)]
    if not found:
        raise ValueError("no JSON list in the answer")
    return max(found, key=_list_score)


def _object_score(item: dict) -> int:
    """Points for a list of themes with tips, and for a reason."""
    listed = item.get("categories") or item.get("rubrics") or item.get("items")
    score = 3 if item.get("reason") else 0
    if isinstance(listed, list):
        objects = [x for x in listed if isinstance(x, dict)]
        named = sum(bool(x.get("theme") or x.get("dimension") or x.get("criterion")) for x in objects)
        score += 20 + 5 * len(objects) + 3 * named + 2 * sum(bool(x.get("tips")) for x in objects) - 4 * sum(isinstance(x, str) for x in listed)
    return score


def extract_object(text: str | None) -> dict:
    """The JSON object in a model's answer, a list as its categories; the best of several. Without any, ValueError."""
    plain = _unfenced(text)
    wrap = lambda x: {"categories": x} if isinstance(x, list) else x if isinstance(x, dict) else None
    if (got := wrap(_json(plain))) is not None:
        return got
    found = [w for x in _embedded(plain, r"[{\[]") if (w := wrap(x)) is not None]
    if not found:
        raise ValueError("no JSON object or list in the answer")
    return max(found, key=_object_score)


def _text(v) -> str:
    if v is None or v == "":
        return ""
    return v.strip() if isinstance(v, str) else str(v) if isinstance(v, bool | int | float) else json.dumps(v, ensure_ascii=False, default=str)


def _texts(v) -> list[str]:
    parts = v if isinstance(v, list) else v.values() if isinstance(v, dict) else [v]
    return [t for x in parts if (t := _text(x))]


def _filled(item: dict, names: tuple[str, ...]) -> Iterator:
    return (item[k] for k in names if item.get(k) is not None and item[k] != "")


def _first(item: dict, names: tuple[str, ...], default: str = "") -> str:
    """The text of the first filled field; of a list, its first text, and the next field where it has none."""
    for v in _filled(item, names):
        if not isinstance(v, list):
            return _text(v)
        if said := _texts(v):
            return said[0]
    return default


def _listed(item: dict, names: tuple[str, ...]) -> list[str]:
    v = next(_filled(item, names), None)
    return [] if v is None else _texts(v)


def candidates_in(value, depth: int = 0) -> Iterator:
    """What may be a criterion in nested lists and objects, three levels deep. Texts in a list take the other fields of its object."""
    if depth > 3 or not isinstance(value, list | dict):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from candidates_in(x, depth + 1)
    else:
        lists = [k for k in LIST_KEYS if isinstance(value.get(k), list)]
        for k in lists:
            rest = {n: v for n, v in value.items() if n != k}
            for x in value[k]:
                if isinstance(x, str):
                    yield rest | {"criterion": x}
                else:
                    yield from candidates_in(x, depth + 1)
        if not lists or _first(value, ("criterion", "description", "rubric", "rule", "requirement")):
            yield value


def normalise_guide(raw):
    """How to verify: an object with lists and texts under their own names and what else it has; a list as checks; a text. None without any."""
    if raw is None or raw == "":
        return None
    if isinstance(raw, list):
        return {"checks": said} if (said := _texts(raw)) else None
    if not isinstance(raw, dict):
        return str(raw).strip()
    known = {n for names in [*GUIDE_LISTS.values(), *GUIDE_TEXTS.values()] for n in names}
    out = {k: _listed(raw, names) for k, names in GUIDE_LISTS.items()} | {k: _first(raw, names) for k, names in GUIDE_TEXTS.items()}
    out = {k: v for k, v in out.items() if v}
    more = {k: _texts(v) if isinstance(v, list) else v for k, v in raw.items() if k not in known and v not in (None, "", [])}
    return (out | more) or None


def severity_of(word: str) -> str:
    w = word.strip().lower()
    return "high" if w in HIGH else "low" if w in LOW else "medium"


def _guide_of(item: dict):
    return normalise_guide(next((item[k] for k in GUIDE if item.get(k)), None))


def normalise_item(raw) -> dict | None:
    """A criterion with its fields by their aliases; None for what is no object or has no criterion."""
    if not isinstance(raw, dict) or not (criterion := _first(raw, CRITERION)):
        return None
    out = {
        "dimension": _first(raw, DIMENSION, DEFAULT_DIMENSION), "criterion": criterion, "positive_evidence": _listed(raw, POSITIVE), "negative_evidence": _listed(raw, NEGATIVE),
        "severity": severity_of(_first(raw, SEVERITY, "medium")), "rationale": _first(raw, RATIONALE),
    }
    if isinstance(inner := raw.get("evidence"), dict):
        out |= {k: _listed(inner, names) for k, names in OF_EVIDENCE.items() if not out[k]}
    return out | {"verification_guide": _guide_of(raw)}


def normalise_items(raw: list) -> list[dict]:
    return [x for c in candidates_in(raw, -1) if (x := normalise_item(c))]


def names_only(theme: str) -> bool:
    """A path or a record's name rather than a theme."""
    return not theme or ("/" in theme and " " not in theme) or theme.lower().startswith(NAMES_ONLY)


def merged_categories(parsed: dict) -> list[dict]:
    """Merged criteria of a model's answer: theme, tips, verification_guide, source_pair_ids.

    Without tips, a criterion that differs from the theme is one; without a theme, the first tip
    is it. A name alone is left out. Objects that only hold a list are opened.
    """

    def opened(values: list) -> Iterator:
        for x in values:
            inner = next((x[k] for k in NESTED_LISTS if isinstance(x.get(k), list)), None) if isinstance(x, dict) else None
            if inner and not x.get("theme"):
                yield from opened(inner)
            else:
                yield x

    def one(item: dict) -> dict | None:
        theme, tips = _first(item, THEME), _listed(item, TIPS)
        if not tips and (said := _first(item, TIP)) and said != theme:
            tips = [said]
        if not theme and tips:
            theme, tips = tips[0], tips[1:]
        if not theme or (names_only(theme) and not tips and not item.get("verification_guide")):
            return None
        more = {"verification_guide": _guide_of(item), "source_pair_ids": _listed(item, SOURCES)}
        return {"theme": theme, "tips": tips} | {k: v for k, v in more.items() if v}

    listed = next((parsed[k] for k in MERGED_LISTS if isinstance(parsed.get(k), list)), [])
    return [c for x in opened(listed) if isinstance(x, dict) and (c := one(x))]


def _parsed(answers: DataFrame, answer: str, name: str, kind: str, read: Callable[[str | None], list]) -> DataFrame:
    """All columns, the list that read gives for an answer ([] on an error), and parse_error."""
    ship(answers.sparkSession)

    @F.pandas_udf(f"struct<items:array<struct<{kind}>>,parse_error:string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple[list, str | None]:
            try:
                return [{k: json.dumps(v, ensure_ascii=False) if k == "verification_guide" and v is not None else v for k, v in x.items()} for x in read(t)], None
            except ValueError as e:
                return [], str(e)

        return pd.DataFrame([one(t) for t in texts], columns=["items", "parse_error"])

    got = answers.withColumn("__parsed", parse(F.col(answer)))
    return got.withColumns({name: F.col("__parsed.items"), "parse_error": F.col("__parsed.parse_error")}).drop("__parsed")


def _ddl(fields: str) -> str:
    return ",".join(f"{n}:{k}" for n, k in (f.strip().split(" ") for f in fields.split(", ")))


def parse_rubrics(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """All columns, rubrics (the criteria in a model's answer; a guide as JSON) and parse_error where it holds no list."""
    return _parsed(answers, answer, "rubrics", _ddl(ITEM), lambda t: normalise_items(extract_array(t)))


MERGED = "theme string, tips array<string>, verification_guide string, source_pair_ids array<string>"


def parse_merged(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """All columns, categories (merged criteria of a model's answer) and parse_error where it holds no object or list."""
    blank = {"theme": None, "tips": [], "verification_guide": None, "source_pair_ids": []}
    return _parsed(answers, answer, "categories", _ddl(MERGED), lambda t: [blank | c for c in merged_categories(extract_object(t))])


def flatten(rubrics: DataFrame, key: str, items: str) -> DataFrame:
    """A row for each criterion: key, rubric_id, at, and its fields (PRJ-35)."""
    each = rubrics.select(key, F.posexplode(items).alias("at", "r"))
    return each.select(key, F.concat(F.col(key), F.lit("#rubric_"), F.col("at")).alias("rubric_id"), "at", "r.*")


def merge_groups(pairs: DataFrame, rubrics: DataFrame, by: str, least: int = 2, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Groups of pairs that have criteria: group_id, pair_count, rubric_count, source_pair_ids, missing_pair_ids, domains.

    Pairs are (pair_id, by, …, domain); rubrics are a row each. Groups of fewer than `least` such
    pairs go; they come by size, then name, up to a limit. domains counts the pairs of each
    domain, the largest first (AGG-7, AGG-8, JN-5, TOP of groups).
    """
    n = rubrics.groupBy("pair_id").agg(F.count("*").alias("n_rubrics"))
    both = pairs.join(n, "pair_id", "left").withColumn("group_id", F.col(by))
    both = both.where(F.col("group_id").isin(ids)) if ids else both
    has = F.col("n_rubrics").isNotNull()
    domains = both.where(has & (F.coalesce("domain", F.lit("")) != "")).groupBy("group_id", "domain").agg(F.count("*").alias("n")) if "domain" in both.columns else None
    out = both.groupBy("group_id").agg(
        F.count("n_rubrics").alias("pair_count"), F.coalesce(F.sum("n_rubrics"), F.lit(0)).alias("rubric_count"), F.array_sort(F.collect_list(F.when(has, F.col("pair_id")))).alias("source_pair_ids"),
        F.array_sort(F.collect_list(F.when(~has, F.col("pair_id")))).alias("missing_pair_ids"),
    ).where(F.col("pair_count") >= least)
    if domains is not None:
        out = out.join(domains.groupBy("group_id").agg(counts_by_size(F.col("domain"), F.col("n")).alias("domains")), "group_id", "left")
    return out.orderBy(F.desc("pair_count"), "group_id").limit(limit) if limit is not None else out


def pair_contexts(pairs: DataFrame) -> DataFrame:
    """pair_id, domain, jobname, query of pairs with an id; the domain is the first part of the id where it is missing."""
    named = pairs.where(F.coalesce("pair_id", F.lit("")) != "")
    domain = F.coalesce(F.nullif("domain", F.lit("")), F.nullif(F.substring_index("pair_id", "/", 1), F.lit("")), F.lit("unknown"))
    return named.select("pair_id", domain.alias("domain"), "jobname", F.trim(F.coalesce("query", F.lit(""))).alias("query")).dropDuplicates(["pair_id"])


def member_contexts(members: DataFrame, contexts: DataFrame) -> DataFrame:
    """Members (cluster_id, pair_id, domain, jobname, task_instruction) with their pair's context, their own fields where it has none."""
    named = members.where((F.coalesce("cluster_id", F.lit("")) != "") & (F.coalesce("pair_id", F.lit("")) != ""))
    got = named.alias("m").join(contexts.alias("c"), F.col("m.pair_id") == F.col("c.pair_id"), "left")
    found = F.col("c.pair_id").isNotNull()
    own = lambda c, other: F.when(found, F.col(f"c.{c}")).otherwise(F.col(f"m.{other}")).alias(c)
    return got.select("m.cluster_id", "m.pair_id", own("domain", "domain"), own("jobname", "jobname"), own("query", "task_instruction"))


def selected_rubrics(sources: DataFrame, picked: DataFrame) -> DataFrame:
    """group_id, pair_id, rubrics: the picked criteria (group_id, rubric_id, rank_no) of each pair in the order of their choice (PRJ-36)."""
    kept = sources.join(picked, ["group_id", "rubric_id"])
    fields = [c for c in sources.columns if c not in ("group_id", "pair_id")]
    listed = F.array_sort(F.collect_list(F.struct("rank_no", F.struct(*fields).alias("rubric"))))
    return kept.groupBy("group_id", "pair_id").agg(F.transform(listed, lambda x: x["rubric"]).alias("rubrics"))


def rubric_line(r: Column) -> Column:
    """A criterion in one line of name=value parts; three items of each list."""
    some = lambda c: F.array_join(F.slice(F.filter(F.transform(c, strip), lambda x: x != ""), 1, 3), "; ")
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}="), c))
    guide = lambda k: some(F.from_json(F.get_json_object(r["verification_guide"], f"$.{k}"), "array<string>"))
    return F.concat_ws(
        " | ", part("dimension", strip(r["dimension"])), part("criterion", strip(r["criterion"])), part("positive_patterns", some(r["positive_evidence"])), part("negative_patterns", some(r["negative_evidence"])),
        part("extract", guide("what_to_extract")), part("checks", guide("checks")), part("evidence_pattern", strip(F.get_json_object(r["verification_guide"], "$.evidence_pattern"))),
    )


def group_text(pairs: DataFrame, most: int = 180, width: int = 1200) -> DataFrame:
    """(group_id, text) of pairs (group_id, pair_id, query, rubrics): the first criteria of a group, in order of pairs, and how many there are more (TOP-11)."""
    each = pairs.select("group_id", "pair_id", "query", F.posexplode("rubrics").alias("at", "r"))
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("group_id").orderBy("pair_id", "at"))).withColumn("total", F.count("*").over(Window.partitionBy("group_id")))
    kept = ranked.where(F.col("n") <= most) if most > 0 else ranked
    line = F.concat(F.lit("- "), one_line(rubric_line(F.col("r")), width) if width > 0 else rubric_line(F.col("r")))
    blocks = kept.groupBy("group_id", "pair_id", "query").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"), F.max("total").alias("total"), F.count("*").alias("shown"))
    head = F.concat(F.lit("pair_id: "), "pair_id", F.lit("\nquery: "), one_line(F.col("query"), 600), F.lit("\nrubrics:\n"))
    text = F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    out = blocks.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(F.get("l", F.lit(0))["n"].alias("n"), text.alias("text")))).alias("b"), F.max("total").alias("total"), F.sum("shown").alias("shown"))
    more = F.when(F.col("total") > F.col("shown"), F.format_string("...[truncated: rendered %d of %d rubrics]...", "shown", "total"))
    return out.select("group_id", F.concat_ws("\n\n---\n\n", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n---\n\n"), more).alias("text"))


def coding_rate(x: np.ndarray, eps: float = 0.1) -> float:
    """Sum of log(1 + s² / (eps² n)) over the singular values that reach 95 % of the energy."""
    if not len(x):
        return 0.0
    s = np.linalg.svd(x, compute_uv=False) ** 2
    keep = int(np.searchsorted(np.cumsum(s) / (s.sum() + 1e-8), 0.95)) + 1
    return float(np.log(1 + s[:keep] / (eps**2 * len(x)) + 1e-8).sum())


def select_by_coding_rate(x: np.ndarray, most: int = 80, batch: int = 5, least_gain: float = 0.001, patience: int = 3, eps: float = 0.1) -> list[int]:
    """Rows chosen greedily for the largest gain of the coding rate, the lowest number on a tie."""
    if x.shape[1] > min(len(x), 100):  # principal components are of centred rows; others stay as they are
        x = x - x.mean(0)
        x = x @ np.linalg.svd(x, full_matrices=False)[2][: min(len(x), 100)].T
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    chosen: list[int] = []
    rate, low = 0.0, 0
    while len(chosen) < min(most, len(x)):
        before = rate
        for _ in range(min(batch, most - len(chosen), len(x) - len(chosen))):
            rates = [(coding_rate(x[[*chosen, i]], eps), -i) for i in range(len(x)) if i not in chosen]
            rate, i = max(rates)
            chosen.append(-i)
        low = low + 1 if rate - before < least_gain else 0
        if low >= patience:
            break
    return chosen


def mcr_selection(rows: DataFrame, group: str, most: int = 80) -> DataFrame:
    """(group, id, rank_no) of the selected rows of each group (group, id, vector); sequential within a group."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id").reset_index(drop=True)
        at = list(range(len(g))) if len(g) <= most else select_by_coding_rate(np.stack(g["vector"]).astype(float), most)
        return pd.DataFrame({group: g[group].iloc[at].to_numpy(), "id": g["id"].iloc[at].to_numpy(), "rank_no": range(1, len(at) + 1)})

    ship(rows.sparkSession)
    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "id", "vector").groupBy(group).applyInPandas(one, f"{group} {kind}, id long, rank_no long")


def from_merged(items: Column) -> Column:
    """Merged criteria as criteria of a pair: the theme with its tips, which also count as positive evidence.

    Items have theme, dimension, criterion, description, tips, verification_guide (checks,
    what_to_extract), negative_evidence, severity, rationale, reason and source_pair_ids. An item
    without a theme is named by its first tip; without tips too, it is left out.
    """
    texts = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != "")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))

    def named(x: Column) -> Column:
        theme, tips = F.coalesce(*[filled(x[k]) for k in ("theme", "dimension", "criterion", "description")]), texts(x["tips"])
        rest = F.when(theme.isNull() & (F.size(tips) > 0), F.slice(tips, 2, F.greatest(F.size(tips), F.lit(1)))).otherwise(tips)
        return F.struct(F.coalesce(theme, F.get(tips, F.lit(0))).alias("theme"), rest.alias("tips"), x.alias("x"))

    def criterion(r: Column) -> Column:
        x, tips = r["x"], r["tips"]
        listed = F.when(F.size(tips) > 0, F.concat(F.lit("\nTips:\n"), F.array_join(F.transform(tips, lambda t: F.concat(F.lit("- "), t)), "\n"))).otherwise("")
        guide = x["verification_guide"]
        checks, extract = texts(guide["checks"]), texts(guide["what_to_extract"])
        return F.struct(
            F.substring(r["theme"], 1, 160).alias("dimension"), F.concat(r["theme"], listed).alias("criterion"),
            F.when(F.size(tips) > 0, tips).when(F.size(checks) > 0, checks).otherwise(extract).alias("positive_evidence"),
            texts(x["negative_evidence"]).alias("negative_evidence"), F.lower(F.coalesce(filled(x["severity"]), F.lit("medium"))).alias("severity"),
            F.coalesce(filled(x["rationale"]), filled(x["reason"]), F.lit("")).alias("rationale"), guide.alias("verification_guide"), texts(x["source_pair_ids"]).alias("source_pair_ids"),
        )

    return F.transform(F.filter(F.transform(items, named), lambda r: r["theme"].isNotNull()), criterion)


def for_members(merged: DataFrame, members: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Members (pair_id, by, …) with the criteria of their group, and the groups that have none (JN-17, JN-18).

    Members without an id or a group are left out.
    """
    adapted = merged.select(by, from_merged(F.col("rubrics")).alias("rubrics")).where(F.size("rubrics") > 0)
    named = members.where((F.coalesce("pair_id", F.lit("")) != "") & (F.coalesce(by, F.lit("")) != ""))
    missing = named.select(by).distinct().join(adapted.select(by), by, "left_anti")
    return named.join(adapted, by).withColumn("source_group_id", F.col(by)), missing
