"""Questions compiled to filters and search text, as column expressions.

One question is a table of one row; a million questions take the same plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words, names, periods, spellings and synonyms that results depend on.
COMPARATIVE = ("compare", "comparison", "versus", "vs", "difference", "better", "worse", "ကွဲပြား", "ယှဉ်", "နှိုင်း", "ဘယ်ဟာက", "ဘယ်ဟာပို", "differences")
ANALYTICAL = ("trend", "pattern", "analy", "explain", "why", "reason", "relationship", "correlat", "ပြောင်းလဲ", "ခေတ်ရေစီးကြောင်း", "ဘာကြောင့်", "ရှင်းပြ", "ဆက်စပ်", "ခွဲခြမ်း")
FACTUAL = ("who", "what", "when", "where", "how much", "how many", "amount", "total", "number", "ဘယ်သူ", "ဘယ်", "ဘယ်နှစ်", "ဘယ်လောက်", "ဘယ်အချိန်", "ဘယ်နေ့", "ဘယ်မှာ", "ပမာဏ", "စုစုပေါင်း")
NEGATION = ("မဟုတ်", "မရှိ")
CONJUNCTIONS = ("နဲ့", "သို့", "ဒါပေမယ့်")
AMBIGUOUS = ("အဲဒါ", "ဒါ", "ဟို", "ဘယ်လို", "ဘာလဲ", "ဘယ်")
STOPWORDS = (
    "show", "list", "tell", "give", "find", "does", "have", "has", "from", "this", "that", "what", "when", "where", "which", "who",
    "will", "would", "could", "should", "can", "need", "want", "there", "their", "with", "about", "into", "over", "than",
    "then", "also", "just", "very", "been", "were", "being", "more", "some", "any", "each", "every", "both", "most",
    "first", "last", "next", "other", "after", "before", "between", "your", "yours", "ours", "theirs", "mine", "his", "hers", "its",
    "make", "made", "done", "get", "got", "see", "saw", "use", "used", "like", "good", "well", "way", "know", "take", "think",
    "yesterday", "today", "tomorrow",
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MYANMAR_MONTHS = ("ဇန်နဝါရီ", "ဖေဖော်ဝါရီ", "မတ်", "ဧပြီ", "မေ", "ဇွန်", "ဇူလိုင်", "ဩဂုတ်", "စက်တင်ဘာ", "အောက်တိုဘာ", "နိုဝင်ဘာ", "ဒီဇင်ဘာ")
MYANMAR_DIGITS = "၀၁၂၃၄၅၆၇၈၉"
PERIODS = (
    ("ဒီနေ့|ယနေ့", "today"), ("မနေ့", "yesterday"), ("ဒီတစ်ပတ်", "this_week"), ("ဒီတစ်လ|ဒီလ", "this_month"), ("ဒီတစ်နှစ်", "this_year"),
    (r"ပြီးခဲ့တဲ့\s*အပတ်", "last_week"), (r"ပြီးခဲ့တဲ့\s*လ", "last_month"), (r"ပြီးခဲ့တဲ့\s*နှစ်", "last_year"),
    (r"(?i)\bthis\s*day\b|\btoday\b", "today"), (r"(?i)\byesterday\b|\blast\s*night\b", "yesterday"), (r"(?i)\bthis\s*week\b", "this_week"),
    (r"(?i)\bthis\s*month\b", "this_month"), (r"(?i)\bthis\s*year\b", "this_year"), (r"(?i)\blast\s*week\b", "last_week"),
    (r"(?i)\blast\s*month\b", "last_month"), (r"(?i)\blast\s*year\b", "last_year"),
)
SPELLING = (("ရသဥတု", "ရာသီဥတု"), ("္မန်မာ", "မြန်မာ"), ("ကွန်ပျုတာ", "ကွန်ပျူတာ"), ("နည်းပညာာ", "နည်းပညာ"), ("ရုက္ခဗေဒိ", "ရုက္ခဗေဒ"))
SYNONYMS = {"ရာသီဥတု": ("မိုးလေဝသ",), "မြန်မာ": ("မြန်မာနိုင်ငံ",), "ကား": ("ယာဉ်", "မော်တော်"), "လေယာဉ်": ("လေကြောင်း",), "ဆရာဝန်": ("ဒေါက်တာ",), "ကျောင်း": ("ပညာရေး",)}

_MONTH = "(" + "|".join(MONTHS) + ")"


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def normalise(question: Column) -> Column:
    """Trimmed, at most 1000 characters; a year and month without a day gets the month's name."""
    text = F.substring(F.trim(question), 1, 1000)
    for k, month in enumerate(MONTHS, 1):
        text = F.regexp_replace(text, rf"\b(\d{{4}})-{k:02d}\b(?!-\d)", f"$1-{month}")
    return text


def classify(question: Column) -> Column:
    """comparative, analytical, factual or generic: the first that has a word in the question."""
    q = F.lower(question)
    return F.when(_any(q, COMPARATIVE), "comparative").when(_any(q, ANALYTICAL), "analytical").when(_any(q, FACTUAL), "factual").otherwise("generic")


def complexity(question: Column) -> Column:
    """0 to 3 for the number of words, 2 for a negation, 1 for each conjunction present, 2 for an ambiguous word."""
    n = F.size(F.split(F.trim(question), r"\s+"))
    score = F.when(n <= 3, 0).when(n <= 6, 1).when(n <= 10, 2).otherwise(3)
    score += F.when(_any(question, NEGATION), 2).otherwise(0) + F.when(_any(question, AMBIGUOUS), 2).otherwise(0)
    for word in CONJUNCTIONS:
        score += F.contains(question, F.lit(word)).cast("int")
    return score


def is_myanmar(text: Column) -> Column:
    return text.rlike(r"[\x{1000}-\x{109F}]")


def fix_spelling(text: Column) -> Column:
    for wrong, right in SPELLING:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def expand_synonyms(text: Column) -> Column:
    """Synonyms of contained words, appended where they are absent."""
    extra = [F.when(F.contains(text, F.lit(word)) & ~F.contains(text, F.lit(other)), F.lit(other)) for word, others in SYNONYMS.items() for other in others]
    return F.concat_ws(" ", text, *extra)


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("date").alias("from"), b.cast("date").alias("to"))


def _period_days(name: str, today: Column) -> Column:
    week, month, year = (F.trunc(today, unit) for unit in ("week", "month", "year"))
    first, last = {
        "today": (today, today),
        "yesterday": (F.date_sub(today, 1), F.date_sub(today, 1)),
        "this_week": (week, F.date_add(week, 6)),
        "this_month": (month, F.last_day(today)),
        "this_year": (year, F.date_sub(F.add_months(year, 12), 1)),
        "last_week": (F.date_sub(week, 7), F.date_sub(week, 1)),
        "last_month": (F.add_months(month, -1), F.date_sub(month, 1)),
        "last_year": (F.add_months(year, -12), F.date_sub(year, 1)),
    }[name]
    return _span(first, last)


def period_range(period: Column, today: Column) -> Column:
    """Dates of a named period; weeks start on Monday."""
    return F.coalesce(*[F.when(period == name, _period_days(name, today)) for name in dict.fromkeys(name for _, name in PERIODS)])


def relative_period(question: Column) -> Column:
    """The first named period in the question."""
    return F.coalesce(*[F.when(question.rlike(pattern), F.lit(name)) for pattern, name in PERIODS])


def resolve_times(question: Column, today: Column) -> Column:
    """The question with the words of named periods put as dates, ``a to b`` for spans; English "last week" and the like stay."""
    for pattern, name in PERIODS:
        if not (name.startswith("last_") and pattern.startswith("(?i)")):
            span = _period_days(name, today)
            first, last = span["from"].cast("string"), span["to"].cast("string")
            question = F.regexp_replace(question, pattern, first if name in ("today", "yesterday") else F.concat(first, F.lit(" to "), last))
    return question


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in the expression."""
    return F.transform(F.array(value), use)[0]


#: What of a question can be a date, in one pass: a form that is part of a more exact one gives way, and other words are passed over whole.
_NAMES = "|".join(MONTHS)
_BURMESE = "|".join(MYANMAR_MONTHS)
_LEXEMES = (
    r"(?i)(\b\d{4}-\d{2}-\d{2}\b" rf"|\b\d{{4}}-(?:\d{{2}}|{_NAMES})\b" rf"|\b(?:{_NAMES})\s+\d{{1,2}}\b" r"|\bQ[1-4]\s*\d{4}\b(?!-\d)" rf"|\b(?:{_NAMES})\s+\d{{4}}\b(?!-\d)"
    rf"|\d{{4}}\s*ခုနှစ်\s*(?:{_BURMESE})လ|(?:{_BURMESE})လ(?:\s*\d{{4}}(?![-\d]))?" r"|\b\d{4}\b)|\w+"
)


def _month_of(lexeme: Column) -> Column:
    """The number of the month whose name, of either language, a lexeme holds; 0 for none."""
    english = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(F.regexp_extract(lexeme, rf"(?i)({_NAMES})", 1)))
    return F.greatest(english, F.array_position(F.array(*[F.lit(m) for m in MYANMAR_MONTHS]), F.regexp_extract(lexeme, rf"({_BURMESE})လ", 1))).cast("int")


def _dated(lexeme: Column, today: Column) -> Column:
    """Rank, first and last day of a lexeme; the most exact form has the least rank, what is no date has null days.

    A day after the month's end is the month's last where the month is named, the whole month where it is a number.
    """
    number = lambda pattern, k=1: F.regexp_extract(lexeme, pattern, k).try_cast("int")
    named = lexeme.rlike(rf"(?i){_NAMES}")
    burmese = lexeme.rlike(_BURMESE)
    rank = (
        F.when(lexeme.rlike(r"^\d{4}-\d{2}-\d{2}$"), 1).when(lexeme.rlike(r"^\d{4}-"), 2).when(lexeme.rlike(r"(?i)^Q[1-4]\s*\d{4}$"), 4).when(burmese, 6)
        .when(named & lexeme.rlike(r"\s\d{1,2}$"), 3).when(named & lexeme.rlike(r"\s\d{4}$"), 5).when(lexeme.rlike(r"^\d{4}$"), 7)
    )
    parts = F.struct(
        rank.alias("rank"),
        F.coalesce(number(r"(?i)^q[1-4]\s*(\d{4})$"), number(r"(\d{4})"), F.year(today)).alias("y"),
        F.coalesce(F.when(lexeme.rlike(r"^\d{4}-\d"), number(r"^\d{4}-(\d{2})")), F.when(lexeme.rlike("(?i)^q"), number(r"(?i)^q([1-4])") * 3 - 2), F.nullif(_month_of(lexeme), F.lit(0)), F.lit(1)).alias("m"),
        F.coalesce(number(r"^\d{4}-\d{2}-(\d{2})$"), number(r"\s(\d{1,2})$"), F.lit(1)).alias("d"),
    )

    def days(p: Column) -> Column:
        fits = p["rank"].isNotNull() & p["m"].between(1, 12) & (p["d"] >= 1)

        def span(first: Column) -> Column:
            last = F.last_day(first)
            day = F.when((p["rank"] == 3) | (p["rank"] == 1) & (p["d"] <= F.dayofmonth(last)), F.least(F.date_add(first, p["d"] - 1), last))
            end = F.when(p["rank"] == 4, F.last_day(F.add_months(first, 2))).when(p["rank"] == 7, F.last_day(F.add_months(first, 11))).otherwise(last)
            return F.struct(p["rank"].alias("rank"), F.coalesce(day, first).alias("from"), F.coalesce(day, end).alias("to"))

        return _bound(F.when(fits, F.make_date(p["y"], p["m"], F.lit(1))), span)

    return _bound(parts, days)


def date_range(question: Column, today: Column) -> Column:
    """``from`` and ``to`` of the dates that a question names, or null.

    Digits of either script count. The most exact form wins, then the first: day, month, month
    name and day, quarter, month name and year, Myanmar months (of this year, if they name none), year; then
    named periods. A day after the end of a named month is its last, after that of a numbered one the whole month; other impossible dates give no range.
    """
    lexemes = F.filter(F.regexp_extract_all(F.translate(question, MYANMAR_DIGITS, "0123456789"), F.lit(_LEXEMES), 1), lambda x: x != "")
    said = F.transform(lexemes, lambda x, i: F.struct(_dated(x, today).alias("day"), i.alias("at")))
    found = F.transform(F.filter(said, lambda x: x["day"]["from"].isNotNull()), lambda x: F.struct(x["day"]["rank"].alias("rank"), x["at"].alias("at"), _span(x["day"]["from"], x["day"]["to"]).alias("days")))
    return F.coalesce(_bound(F.array_min(found), lambda best: best["days"]), _bound(relative_period(question), lambda p: period_range(p, today)))


def search_terms(question: Column) -> Column:
    """ASCII content words of a question: no dates, stopwords, or words under three letters; distinct, in order."""
    text = F.regexp_replace(question, r"\b\d{4}[-./]\d{1,2}([-./]\d{1,2})?\b", " ")
    text = F.regexp_replace(text, rf"(?i)\b\d{{4}}[-./]{_MONTH}\b|\b{_MONTH}\s+\d{{1,2}}\b", " ")
    text = F.regexp_replace(text, rf"(?i)\b\d{{4}}\b|\bQ[1-4]\b|\b{_MONTH}\b", " ")
    text = F.regexp_replace(text, r"[^a-zA-Z0-9\-. ]", " ")
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[-.]+|[-.]+$", ""))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, F.lower(w))))


def without_names(question: Column, names: Column, project: Column) -> Column:
    """The question without the given names (an array; a trailing ``(...)`` may be absent) and project, in any case."""
    literal = lambda x: F.concat(F.lit("(?i)\\Q"), x, F.lit("\\E"))
    base = lambda x: F.regexp_replace(x, r"\s*\([^)]*\)$", "")
    strip = lambda text, x: F.when(x.isNull() | (x == ""), text).otherwise(F.regexp_replace(text, literal(x), F.lit(" ")))
    bare = F.aggregate(F.coalesce(names, F.array().cast("array<string>")), question, lambda s, n: strip(strip(s, n), base(n)))
    return strip(bare, project)


def asked_terms(bare: Column, question: Column) -> Column:
    """The search terms of a question without its names; if none are left, the words of the whole question but dates, stopwords too."""
    undated = F.regexp_replace(question, r"\b\d{4}[-./]\d{1,2}([-./]\d{1,2})?\b|\b\d{4}\b", " ")
    words = F.filter(F.split(F.regexp_replace(undated, r"[^a-zA-Z0-9]+", " "), " "), lambda w: F.length(w) > 2)
    return _bound(search_terms(bare), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array_distinct(words)))


def search_groups(terms: Column, question: Column, also: Column) -> Column:
    """Structs (group, term, negated) of a boolean search: all terms must occur, a term before a negator must not.

    A term that the map ``also`` (lower case to other words) holds may be replaced by each word of the other in turn. Terms with signs inside are several.
    """
    marked = F.transform(F.filter(_asked_tokens(question), lambda x: x["negated"]), lambda x: F.lower(x["word"]))
    spread = lambda text: F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    row = lambda group, term, said: F.struct(group.alias("group"), term.alias("term"), F.array_contains(marked, F.lower(said)).alias("negated"))

    def groups(said: Column, i: Column) -> Column:
        own = F.transform(spread(said), lambda w, j: row(F.concat_ws(".", i, j), w, said))
        other = F.try_element_at(also, F.lower(said))
        either = F.flatten(F.transform(spread(other), lambda w, j: F.array(row(F.concat_ws(".", i, j), F.lower(said), said), row(F.concat_ws(".", i, j), w, said))))
        return F.when(F.coalesce(F.size(spread(other)), F.lit(0)) > 0, either).otherwise(own)

    return F.flatten(F.transform(terms, groups))


def _asked_tokens(question: Column) -> Column:
    """Structs (word, negated) of the words of a question that a boolean search asks for.

    A negator marks the word before it; negators, words of other letters than ASCII, dates and bare numbers go.
    """
    words = F.filter(F.split(question, r"\s+"), lambda w: w != "")
    keep = lambda w: ~w.rlike(r"[^\x00-\x7F]") & ~w.rlike(r"^\d{4}[-./]\d{1,2}([-./]\d{1,2})?$|^\d+$")
    return _bound(words, lambda ws: F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("word"), F.coalesce(F.get(ws, i + 1).rlike("^မဟုတ်"), F.lit(False)).alias("negated"))), lambda x: keep(x["word"])))


def boolean_query(question: Column, also: Column | None = None) -> Column:
    """Terms joined by ``&``; a negator turns the term before it into ``!term``.

    ``also`` (a map from words in lower case) makes ``(term | other)`` of a term that it holds.
    """
    other = (lambda w: F.try_element_at(also, F.lower(w))) if also is not None else (lambda w: F.lit(None).cast("string"))
    group = lambda x: F.when(other(x["word"]) != x["word"], F.concat(F.lit("("), x["word"], F.lit(" | "), other(x["word"]), F.lit(")"))).otherwise(x["word"])
    said = F.transform(_asked_tokens(question), lambda x: F.concat(F.when(x["negated"], "!").otherwise(""), group(x)))
    return F.when(F.size(said) > 0, F.array_join(said, " & "))


def well_formed(search: Column) -> Column:
    """Whether a boolean search has its brackets closed in order, and an operator between all terms and nowhere else."""
    packed = F.regexp_replace(search, r"\s+", "")
    depth = F.aggregate(F.split(packed, ""), F.struct(F.lit(0).alias("open"), F.lit(0).alias("least")), lambda s, c: F.struct((s["open"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("open"), F.least(s["least"], s["open"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("least")))
    return ~packed.rlike(r"^[&|)]|[&|!(]$|[&|(][&|)]|![&|)]|[^&|!(][(!]|\)[^&|)]") & (packed != "") & _bound(depth, lambda d: (d["open"] == 0) & (d["least"] == 0))


def sanitise_boolean(text: Column) -> Column:
    """A boolean search with letters, digits, operators and Burmese only, ``&`` between words that stand side by side.

    Null if nothing is left, or if what is left is not well formed.
    """
    kept = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9\s&|!()'\x{1000}-\x{109F}]", " "), r"\s+", " "))
    joined = F.regexp_replace(kept, r"(?<=[A-Za-z0-9\x{1000}-\x{109F}]) (?=[A-Za-z0-9\x{1000}-\x{109F}])", " & ")
    return _bound(joined, lambda j: F.when(~j.isin("", "''", "()") & well_formed(j), j))


def search_strategy(boolean: Column, plain: Column) -> Column:
    """boolean if there is a boolean search, else plain if there are words, else none."""
    return F.when(boolean.isNotNull() & (boolean != ""), "boolean").when(F.trim(plain) != "", "plain").otherwise("none")
