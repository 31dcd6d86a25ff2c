"""Selection of observation lines: scored cues, quotas by segment or prefix, and fits to a budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_lines, let, norm_ws, one_line, ordered_distinct, split_lines, trim_text

# Lines of a page's tree, what raises or lowers a line's score, controls, and roles of evidence.
UI_LINE = r"(?i)(StaticText|heading|grid|table|region|main|columnheader|rowgroup|gridcell|button|link|textbox|searchbox|combobox|checkbox|alert|option)"
SCORES = (
    (12, ("heading", "grid '", "table '", "region '", "main '")),
    (8, ("statictext", "columnheader", "gridcell")),
    (5, ("link", "button", "textbox", "searchbox", "combobox", "checkbox")),
    (4, ("error", "alert", "invalid", "failed", "no data", "showing rows")),
    (-3, ("generic ''", "section ''", "row ''", "gridcell ''")),
)
BOILERPLATE = ("global skip links", "my servicenow landing page", "show help", "show notifications")
CLICKABLE = ("button", "link", "option", "checkbox", "combobox", "textbox", "searchbox")
ROLES = ("heading", "statictext", "grid", "table", "region", "link", "button", "searchbox", "textbox", "combobox", "alert", "error")
DENSE = ("table", "grid", "heading", "statictext", "alert", "error", "image", "search result")


def any_of(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def how_many(low: Column, words: tuple[str, ...]) -> Column:
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def cue_score(line: Column, at: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """12 for structure, 8 for text, 5 for controls, 4 for markers, 2 for quotes, 1 among the first 20; less 7 for boilerplate, 3 for empty names."""

    def points_of(low: Column) -> Column:
        out = F.when(low.rlike("'[^']{3,}'"), 2).otherwise(0) - F.when(any_of(low, boilerplate), 7).otherwise(0) + F.when(at < 20, 1).otherwise(0)
        for points, words in SCORES:
            out = out + F.when(any_of(low, words), points).otherwise(0)
        return out

    return let(F.lower(line), points_of)


def best_cues(text: Column, limit: int = 48, width: int = 260, least: int = -4) -> Column:
    """The best lines of a page's tree by score, then place; cut to the limit before repeats go. A text without such lines is one cue.

    Places count all lines, blank ones too.
    """
    lines = F.transform(split_lines(text), lambda x, i: F.struct(norm_ws(x).alias("x"), i.alias("i")))
    scored = lambda found: F.transform(found, lambda s: F.struct((-cue_score(s["x"], s["i"])).alias("k"), s["i"].alias("i"), trim_text(s["x"], width).alias("x")))
    kept = lambda found: ordered_distinct(F.transform(F.slice(F.array_sort(F.filter(scored(found), lambda s: s["k"] < -least)), 1, limit), lambda s: s["x"]))
    none = F.array().cast("array<string>")
    alone = let(norm_ws(text), lambda whole: F.when(whole != "", F.array(trim_text(whole, width))).otherwise(none))
    return let(F.filter(lines, lambda s: s["x"].rlike(UI_LINE)), lambda found: F.when(F.size(found) > 0, kept(found)).otherwise(alone))


def ranked_evidence(lines: Column, terms: Column, limit: int) -> Column:
    """The best lines by 10 for a term and 1 for a role, then place; a line without a score stays only in the first four places."""

    def scored(x: Column, i: Column) -> Column:
        hits = lambda low: F.size(F.filter(terms, lambda t: (t != "") & low.contains(F.lower(t))))
        points = lambda clean: let(F.lower(clean), lambda low: -(hits(low) * 10 + how_many(low, ROLES)))
        return let(norm_ws(x), lambda clean: F.struct(points(clean).alias("k"), i.alias("i"), trim_text(clean, 360).alias("x")))

    kept = F.filter(F.transform(lines, scored), lambda s: (s["x"] != "") & ((s["k"] < 0) | (s["i"] < 4)))
    return F.transform(F.slice(F.array_sort(kept), 1, limit), lambda s: s["x"])


def first_cues(text: Column, limit: int) -> Column:
    """The first lines without repeats."""
    return F.slice(ordered_distinct(clean_lines(text)), 1, limit)


def balanced_cues(lines: Column, limit: int) -> Column:
    """An equal share for each prefix before a colon, then the rest in order up to the limit."""
    prefix = lambda x: F.split_part(x, F.lit(":"), F.lit(1))
    marked = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"), prefix(x).alias("p")))
    kinds = F.array_distinct(F.transform(marked, lambda s: s["p"]))
    share = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.size(kinds), F.lit(1))).cast("int"))
    ranked = F.transform(
        marked, lambda s: F.struct((F.size(F.filter(marked, lambda o: (o["p"] == s["p"]) & (o["i"] < s["i"]))) >= share).alias("late"), s["i"].alias("i"), s["x"].alias("x"))
    )
    picked = F.slice(F.array_sort(ranked), 1, limit)
    return F.transform(F.array_sort(F.transform(picked, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])


def segmented_cues(segments: Column, limit: int, width: int) -> Column:
    """An equal share of each segment (section, cues) in order, then what is left of each up to the limit; named by section.

    Blank cues and segments without any are left out; repeats go after the limit.
    """
    tidy = F.transform(
        segments,
        lambda s: F.struct(
            F.coalesce(F.nullif(F.trim(s["section"]), F.lit("")), F.lit("observation")).alias("section"),
            F.transform(F.filter(s["cues"], lambda c: F.trim(c) != ""), lambda c: one_line(c, width)).alias("cues"),
        ),
    )
    filled = F.filter(tidy, lambda s: F.size(s["cues"]) > 0)
    share = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.size(filled), F.lit(1))).cast("int"))
    named = lambda s, part: F.transform(part, lambda c: F.concat(s["section"], F.lit(": "), c))
    first = F.flatten(F.transform(filled, lambda s: named(s, F.slice(s["cues"], F.lit(1), share))))
    rest = F.flatten(F.transform(filled, lambda s: named(s, F.slice(s["cues"], share + 1, F.size(s["cues"])))))
    return ordered_distinct(F.slice(F.concat(first, rest), 1, limit))


def json_size(c: Column) -> Column:
    """Characters of a value as JSON with a blank after each separator.

    Separators inside strings count too, so that the size is the least or a few characters more.
    """
    text = F.to_json(c)
    return F.length(text) + F.size(F.regexp_extract_all(text, F.lit(r'":|,["\[{0-9tfn-]'), 0))


def shrink_card(c: Column) -> Column:
    """A card with ten lines of evidence of 500 characters, without its steps, fields and pictures."""
    lines = F.transform(F.filter(F.slice(c["evidence_lines"], 1, 10), lambda x: F.trim(x) != ""), lambda x: F.substring(x, 1, 500))
    none = F.array().cast("array<string>")
    return c.withField("evidence_lines", lines).withField("screenshot_paths", none).withField("source_fields", none).withField("source_steps", F.array().cast("array<bigint>"))


def fit_cards(cards: Column, most: int, shrink: bool = False) -> Column:
    """The cards before the first whose JSON goes over the limit of characters, always the first; shrunk if it is over alone."""
    opening = 18  # {"state_cards": []}
    state = F.struct(F.lit(0).alias("n"), F.lit(opening).alias("cost"), F.lit(False).alias("full"))

    def step(s: Column, c: Column) -> Column:
        cost = s["cost"] + json_size(c) + F.when(s["n"] > 0, 2).otherwise(0)
        fits = (~s["full"]) & ((s["n"] == 0) | (cost <= most))
        return F.struct(F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(fits, cost).otherwise(s["cost"]).alias("cost"), (~fits).alias("full"))

    fitted = F.aggregate(cards, state, step, lambda s: F.struct(s["n"].alias("n"), (s["cost"] > most).alias("over")))
    kept = F.slice(cards, 1, fitted["n"])
    return F.when(fitted["over"], F.transform(kept, shrink_card)).otherwise(kept) if shrink else kept
