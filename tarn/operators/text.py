"""Text signals: entities by pattern, keyword scores, vocabularies, roles near names, relations, language, summaries.

Word lists are parameters; those of tarn/lists.py are the defaults. Patterns are Unicode-aware. A null text gives no matches and scores of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import small_batches
from ..functions.identifiers import organisation_number, personal_number
from ..lists import FEAR_WORDS, LANGUAGE_MARKS, NEGATIVE_WORDS, POSITIVE_WORDS, RELATION_PATTERNS, SENTIMENT_WEIGHTS, THREAT_WORDS, URGENCY_WORDS, VIOLENCE_WORDS, VOCABULARY

#: Fixed patterns of the extractor, with their confidences.
PATTERNS = {
    "personal_number": (r"\b\d{6,8}[-+]?\d{4}\b", 0.95),
    "organisation_number": (r"\b(?:16)?\d{6}[-]?\d{4}\b", 0.95),
    "phone": (r"\b0\d{1,3}[-\s]?\d{2,3}[-\s]?\d{2,3}[-\s]?\d{2,4}\b", 0.85),
    "email": (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0.95),
    "money": (r"(?i)\b\d{1,3}(?:[\s,]\d{3})*(?:[.,]\d{2})?\s*(?:kr|sek|kronor|miljoner?|mdkr|mkr|tkr)\b", 0.9),
}


def extract(docs: DataFrame, as_of: Column, kinds: Sequence[str] = tuple(PATTERNS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, value) of all matches; numbers only with right check digits."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text_col, F.lit("(" + PATTERNS[k][0] + ")"), F.lit(1)).alias("values")) for k in kinds])
    x = docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("f")).select("doc_id", "f.kind", F.explode("f.values").alias("value"))
    person, company = personal_number(F.col("value"), as_of)["valid"], organisation_number(F.col("value"))["valid"]
    return x.where(F.when(F.col("kind") == "personal_number", person).when(F.col("kind") == "organisation_number", company).otherwise(F.lit(True)))


def spans(docs: DataFrame, kinds: Sequence[str] = tuple(PATTERNS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, stop, value): matches with offsets, overlaps settled greedily by start, then by confidence."""
    import re

    patterns = {k: (re.compile(PATTERNS[k][0]), PATTERNS[k][1]) for k in kinds}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                hits = sorted(((m.start(), -conf, m.end(), k, m.group()) for k, (p, conf) in patterns.items() for m in p.finditer(text or "")))
                end = -1
                for start, _, stop, k, value in hits:
                    if start >= end:
                        rows.append((own, k, start, stop, value))
                        end = stop
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "stop", "value"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, kind string, start long, stop long, value string")


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the lower-cased text, as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum(F.contains(low, F.lit(w)).cast("int") for w in words)


def keyword_score(text: Column, words: Sequence[str]) -> Column:
    """min(1, 2 ln(hits + 1) / ln(words + 1))."""
    import math

    return F.least(F.lit(1.0), 2 * F.ln(keyword_hits(text, words) + 1) / math.log(len(words) + 1))


def polarity(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    p, n = keyword_hits(text, positive), keyword_hits(text, negative)
    return F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0))


def sentiment(text: Column) -> Column:
    """Struct (fear, violence, urgency, threat, polarity, risk): scores of the fixed word lists, and the weighted sum of the first four, at most 1."""
    scores = {k: keyword_score(text, words) for k, words in (("fear", FEAR_WORDS), ("violence", VIOLENCE_WORDS), ("urgency", URGENCY_WORDS), ("threat", THREAT_WORDS))}
    risk = F.least(F.lit(1.0), sum(scores[k] * w for k, w in SENTIMENT_WEIGHTS.items()))
    return F.struct(*[v.alias(k) for k, v in scores.items()], polarity(text, POSITIVE_WORDS, NEGATIVE_WORDS).alias("polarity"), risk.alias("risk"))


SEVERITY_WEIGHT = {"low": 0.2, "medium": 0.5, "high": 1.0}


def severity_weight(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, F.lit(v)) for k, v in SEVERITY_WEIGHT.items()], F.lit(0.5))


def threat_risk(severities: Column) -> Column:
    """Sum of s_i / (i + 1), by falling weight, over 3, at most 1."""
    weights = F.sort_array(F.transform(severities, severity_weight), asc=False)
    return F.least(F.lit(1.0), F.aggregate(F.transform(weights, lambda w, i: w / (i + 1)), F.lit(0.0), lambda a, w: a + w) / 3)


def any_of(words: Iterable[str]) -> str:
    """A pattern that matches any of the words, the longest that fits first: words with a common beginning share it, so a place in a text is tried once a letter, not once a word."""
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [("\\" + ch if not ch.isalnum() and ch != " " else ch) + pattern(child) for ch, child in sorted(node.items()) if ch]
        if not ways:
            return ""
        joined = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return joined + "?" if "" in node else joined

    return pattern(tree)


def vocabulary_hits(text: Column, vocabulary: Mapping[str, Mapping[str, str]] = VOCABULARY, least: str = "low") -> Column:
    """Array of structs (category, word, severity, context) of whole-word matches, in each category the longest first.

    `vocabulary` maps a category to its words with their severities; words below `least` are left out. The context has 50 characters on either side.
    """
    rank = list(SEVERITY_WEIGHT)
    kept = {k: {w.lower(): v for w, v in words.items() if rank.index(v) >= rank.index(least)} for k, words in vocabulary.items()}
    kept = {k: words for k, words in kept.items() if words}
    empty = F.array().cast("array<struct<category:string,word:string,severity:string,context:string>>")
    if not kept:
        return empty
    before, after = r"(?<=(^.{0,49}|.{50}))", r"(?=(.{0,50}))"
    severity = F.create_map(*[F.lit(x) for k, words in kept.items() for w, v in words.items() for x in (f"{k}:{w}", v)])

    def match(category: str):
        level = lambda w: F.element_at(severity, F.concat(F.lit(f"{category}:"), w))
        return lambda m: F.struct(F.lit(category).alias("category"), F.lower(m["b"]).alias("word"), level(F.lower(m["b"])).alias("severity"), F.concat(m["a"], m["b"], m["c"]).alias("context"))

    low, odd = F.lower(text), text.rlike("[\u0130\u017f\u212a\u212b]")

    def whole(words: Iterable[str]) -> str:
        """A whole word; places whose letter begins none are passed over first."""
        return f"(?={'[' + ''.join(sorted({w[0] for w in words})) + ']'})\\b(?:{any_of(words)})\\b"

    def some(words: Iterable[str]) -> Column:
        # letters that only ignoring case makes equal to others are left to the slower pattern
        return low.rlike(f"(?U){whole(words)}") | (odd & text.rlike(f"(?iU){whole(words)}"))

    found = []
    for category, words in kept.items():
        placed = F.lit(f"(?siU)(?={whole(words)}){before}({any_of(words)})\\b{after}")  # the context is taken only where a word stands
        parts = [F.regexp_extract_all(text, placed, F.lit(k)) for k in (1, 2, 3)]
        pairs = F.arrays_zip(parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("c"))
        found.append(F.when(some(words), F.transform(pairs, match(category))).otherwise(empty))
    every = sorted({w for words in kept.values() for w in words})
    return F.when(some(every), F.flatten(F.array(*found))).otherwise(empty)


def vocabulary_matches(docs: DataFrame, vocabulary: Mapping[str, Mapping[str, str]] = VOCABULARY, least: str = "low", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, category, word, severity, context), a row a match."""
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(vocabulary_hits(F.col(text_col), vocabulary, least)))


def combined_risk(text: Column, vocabulary: Mapping[str, Mapping[str, str]] = VOCABULARY) -> Column:
    """Struct (risk, flag): the mean of the sentiment's risk and of the matches' mean severity, the first alone without matches.

    The flag stands where fear, violence or threat exceeds 0.5, or a match is of high severity.
    """
    felt, levels = sentiment(text), F.transform(vocabulary_hits(text, vocabulary), lambda m: m["severity"])
    mean = F.try_divide(F.aggregate(levels, F.lit(0.0), lambda a, v: a + severity_weight(v)), F.size(levels))
    risk = F.coalesce((felt["risk"] + mean) / 2, felt["risk"])
    return F.struct(risk.alias("risk"), ((felt["fear"] > 0.5) | (felt["violence"] > 0.5) | (felt["threat"] > 0.5) | F.array_contains(levels, "high")).alias("flag"))


def summary(text: Column, most: int = 50) -> Column:
    """Leading sentences of at most `most` words in all, up to the first that exceeds them; empty if that is the first of all."""
    sentences = F.split(F.btrim(F.coalesce(text, F.lit(""))), "(?<=[.!?])\\s+")
    size = lambda s: F.size(F.split(s, "\\s+"))
    begin = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))
    walk = F.aggregate(sentences, begin, lambda a, s: F.struct((a["n"] + size(s)).alias("n"), F.when(a["n"] + size(s) <= most, F.concat(a["kept"], F.array(s))).otherwise(a["kept"]).alias("kept")))
    return F.array_join(walk["kept"], " ")


def roles_near_names(docs: DataFrame, roles: Sequence[str], reach: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, role, name, confidence) of lines with a role and capitalised names at most `reach` lines away: 0.8 - 0.15 * distance, the best a pair."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    role = F.regexp_extract(F.lower("line"), "(?U)\\b(" + "|".join(roles) + ")\\b", 1)
    x = lines.select("doc_id", F.col("at").alias("role_at"), role.alias("role")).where("role <> ''")
    names = F.regexp_extract_all("line", F.lit("(?U)\\b(\\p{Lu}\\p{Ll}+ \\p{Lu}\\p{Ll}+)\\b"), F.lit(1))
    y = lines.select("doc_id", "at", F.explode(names).alias("name"))
    near = x.withColumn("at", F.explode(F.sequence(F.col("role_at") - reach, F.col("role_at") + reach))).join(y, ["doc_id", "at"])
    return near.groupBy("doc_id", "role", "name").agg(F.round(F.max(0.8 - 0.15 * F.abs(F.col("at") - F.col("role_at"))), 6).alias("confidence"))


def relations(docs: DataFrame, patterns: Mapping[str, Sequence[str]] = RELATION_PATTERNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, relation, subject, object, confidence) of two-group patterns, each triple once with its highest confidence.

    0.5, and 0.1 more for each name of over ten characters and for each of several words, at most 0.85; names of one character do not count.
    """
    text, empty = F.col(text_col), F.array().cast("array<struct<relation:string,subject:string,object:string>>")
    one, some = r"(\w+(?:\s+\w+)?)", r"(\w+(?:\s+\w+)*)"

    def triple(kind: str):
        return lambda m: F.struct(F.lit(kind).alias("relation"), m["s"].alias("subject"), m["o"].alias("object"))

    hits = []
    for k, several in patterns.items():
        for p in several:
            # what stands between the names is looked for first, so that few texts meet the whole pattern
            core = r"\w" + p.removeprefix(one) if p.startswith(one) else p
            last = next((g for g in (one, some) if core.endswith(g)), "")
            between = text.rlike("(?iU)" + (core.removesuffix(last) + r"\w" if last else core))
            # the same matches faster: none starts within a word, and one character class instead of a repeated group, which overflows the JVM's stack on long texts
            whole = F.lit("(?iU)" + (r"(?:\G|\b)" if p.startswith(one) else "") + p.replace(some, r"(\w(?:[\w\s]*\w)?)"))
            pairs = F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("s"), F.regexp_extract_all(text, whole, F.lit(2)).alias("o"))
            hits.append(F.when(between, F.transform(pairs, triple(k))).otherwise(empty))
    x = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.flatten(F.array(*hits))).alias("h")).select("doc_id", "h.*").where("length(subject) > 1 AND length(object) > 1")
    names = [F.col("subject"), F.col("object")]
    sure = 0.5 + sum(F.when(test, 0.1).otherwise(0.0) for n in names for test in (F.length(n) > 10, F.contains(n, F.lit(" "))))
    return x.groupBy("doc_id", "relation", "subject", "object").agg(F.round(F.max(F.least(F.lit(0.85), sure)), 6).alias("confidence"))


def language(text: Column, marks: Mapping[str, Sequence[str]] = LANGUAGE_MARKS, default: str = "sv") -> Column:
    """The language most of whose marks occur in the lower-cased text, as substrings; the default where several have as many."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = {k: sum(F.contains(low, F.lit(w)).cast("int") for w in words) for k, words in marks.items()}
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    leaders = sum((n == best).cast("int") for n in counts.values())
    return F.when(leaders > 1, F.lit(default)).otherwise(F.coalesce(*[F.when(n == best, F.lit(k)) for k, n in counts.items()]))


def token_entities(docs: DataFrame, model: Callable[[list[str]], Iterable[Iterable[tuple[str, int, int, float]]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, stop, confidence, value) as a token classifier finds them: model(texts) gives (kind, start, stop, confidence) a text.

    The model is a parameter and runs on whole Arrow batches; a null text is an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            rows = [(own, k, a, b, sure, t[a:b]) for own, t, found in zip(pdf["doc_id"], texts, model(texts), strict=True) for k, a, b, sure in found]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "stop", "confidence", "value"])

    schema = "doc_id long, kind string, start long, stop long, confidence double, value string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def justified(text: Column, least: int = 10, garbage: Sequence[str] = ("test", "asdf", "ok", "n/a")) -> Column:
    """Whether a justification has content: length, not a placeholder, three different letters, two words of three letters, no keyboard row."""
    x = F.btrim(F.coalesce(text, F.lit("")))
    low = F.lower(x)
    packed = F.regexp_replace(low, " ", "")
    words = F.size(F.filter(F.split(x, "\\s+"), lambda w: F.length(w) >= 3))
    rows = packed.rlike("^([asdfghjkl]+|[qwertyuiop]+|[zxcvbnm]+|[0-9]+)$")
    return (F.length(x) >= least) & ~low.isin(*garbage) & (F.size(F.array_distinct(F.split(packed, ""))) >= 3) & (words >= 2) & ~rows


def rubber_stamp(seconds: Column, text: Column, least: float = 2.0) -> Column:
    return (seconds < least) | (text.isNotNull() & ~justified(text))


def tagged_fields(docs: DataFrame, tags: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, one column a tag): contents of <tag> elements, zipped by position; missing ones are null."""
    short = lambda t: t.split(":")[-1]
    lists = [F.regexp_extract_all(text_col, F.lit(f"(?is)<{t}(?: [^>]*)?>(.*?)</{t}>"), F.lit(1)).alias(short(t)) for t in tags]
    x = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(*lists)).alias("at", "z"))
    return x.select("doc_id", "at", *[F.btrim(F.col("z")[short(t)]).alias(short(t)) for t in tags])


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments gone, tags to blanks, the commonest entities decoded, white space collapsed."""
    x = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, "(?s)<[^>]+>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.regexp_replace(x, name, mark)
    return F.btrim(F.regexp_replace(x, "\\s+", " "))
