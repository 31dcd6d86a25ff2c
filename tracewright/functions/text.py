"""Text expressions: whitespace, lines, trimming, tokens, ordered distinct, similarity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode line splitting breaks on.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"

# Words that token sets leave out.
STOPWORDS = (
    "the and for with that this from into you are was were has have had not but all can will should must 请 的 了 是 在 和 或 对 从"
).split()
# Openings of long sentences that ask or order.
ASKS = ("what ", "which ", "how ", "where ", "when ", "who ", "tell ", "find ")
ORDERS = ("navigate ", "create ", "order ", "assign ", "filter ", "submit ", "search ")


#: What a strip takes from the ends.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once however often body names it; plans stay small."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(c: Column) -> Column:
    """White space at the ends removed. (F.trim takes two columns, so transform would hand it an item's place.)"""
    return F.trim(c, F.lit(WHITE))


def norm_ws(c: Column) -> Column:
    """Unicode white space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def split_lines(c: Column) -> Column:
    """Lines at every Unicode break; a break at the end opens no empty line."""
    return let(F.split(c, LINE_BREAK), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def clean_lines(c: Column) -> Column:
    """Lines with collapsed white space, blank ones left out."""
    return F.filter(F.transform(split_lines(c), norm_ws), lambda x: x != "")


def trim_text(c: Column, limit: int) -> Column:
    """Runs of blank lines shortened; a text over the limit is cut and marked."""
    cut = lambda t: F.concat(F.rtrim(F.substring(t, 1, max(0, limit - 40))), F.lit("\n...[truncated]..."))
    return let(strip(F.regexp_replace(c, r"\n{3,}", "\n\n")), lambda t: F.when(F.length(t) <= limit, t).otherwise(cut(t)))


def one_line(c: Column, limit: int, reserve: int = 20) -> Column:
    """One line within the limit; a longer one is cut by the reserve and marked."""
    cut = lambda t: F.concat(F.rtrim(F.substring(t, 1, max(0, limit - reserve))), F.lit(" ...[truncated]"))
    return let(norm_ws(c), lambda t: F.when(F.length(t) <= limit, t).otherwise(cut(t)))


def tokens(c: Column, cjk: bool = True) -> Column:
    """Single CJK characters (unless left out), or runs of ASCII letters, digits and underscores, lowered, without stopwords."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[一-鿿]|[a-z0-9_]+" if cjk else "[a-z0-9_]+"), 0), lambda t: ~t.isin(STOPWORDS))


def ordered_distinct(items: Column) -> Column:
    """Trimmed non-empty items, the first spelling of each kept."""
    kept = F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))
    first = lambda k, low: F.transform(F.array_distinct(low), lambda d: F.get(k, (F.array_position(low, d) - 1).cast("int")))
    return let(kept, lambda k: let(F.transform(k, F.lower), lambda low: first(k, low)))


def matched_terms(terms: Column, text: Column) -> Column:
    """Terms that the text holds, whatever their case."""
    return let(F.lower(text), lambda low: F.filter(terms, lambda t: low.contains(F.lower(t))))


def safe_path_part(c: Column) -> Column:
    """A file name: reserved characters become underscores, dots and spaces at the end go."""
    t = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown"))


def slug(c: Column, limit: int = 80) -> Column:
    """Lower-case letters and digits between single underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, limit)


def looks_like_question(c: Column) -> Column:
    """A long sentence that asks or orders."""

    def asks(b: Column) -> Column:
        opens = lambda words: reduce(or_, [b["low"].startswith(w) for w in words])
        return ((b["n"] >= 8) & opens(ASKS)) | ((b["n"] >= 5) & opens(ORDERS)) | ((b["n"] >= 6) & b["low"].endswith("?"))

    return let(strip(c), lambda t: let(F.struct(F.lower(t).alias("low"), F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")).alias("n")), asks))


def first_text(*columns: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def counts_map(keys: Column, counts: Column) -> Column:
    """An aggregate: map of counts by key, keys in order, empty keys left out."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.coalesce(keys, F.lit("")) != "", F.struct(keys, counts)))))


def counts_by_size(keys: Column, counts: Column) -> Column:
    """An aggregate: (key, n) in order of (-n, key), blank keys left out."""
    kept = F.collect_list(F.when(F.trim(F.coalesce(keys, F.lit(""))) != "", F.struct((-counts).alias("less"), keys.alias("key"))))
    return F.transform(F.array_sort(kept), lambda s: F.struct(s["key"].alias("key"), (-s["less"]).alias("n")))


def semantic_similarity(a: Column, b: Column) -> Column:
    """The larger of the cosine of counts and the overlap of two lists of tokens; 0 where one is empty."""
    kinds = lambda x: F.array_distinct(x)
    times = lambda x, t: F.size(F.filter(x, lambda y: y == t)).cast("double")
    total = lambda items, f: F.aggregate(items, F.lit(0.0), lambda s, t: s + f(t))
    dot = total(F.array_intersect(a, b), lambda t: times(a, t) * times(b, t))
    norm = lambda x: F.sqrt(total(kinds(x), lambda t: times(x, t) * times(x, t)))
    cosine = F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))
    return F.greatest(cosine, overlap(a, b))


def overlap(a: Column, b: Column) -> Column:
    """Common distinct items over the smaller number of them; 0 where one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def sequence_similarity(a: Column, b: Column) -> Column:
    """The larger of positional agreement and the Jaccard index; 0 for two empty lists."""
    longest = F.greatest(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    union = F.size(F.array_union(a, b))
    return F.when(longest > 0, F.greatest(same / longest, F.size(F.array_intersect(a, b)) / union)).otherwise(F.lit(0.0))
