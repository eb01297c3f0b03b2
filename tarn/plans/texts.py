"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lists as ls
from ..operators import text as op
from .views import query

c = F.col

#: One of these notes stands before each text, so that the Swedish lists have something to find.
NOTES = (
    "Anna Berg är VD för Nordbolaget. Ring 08-123 45 67 eller skriv till anna.berg@example.se.",
    "Kalle Lind äger Testbolaget Nord. Han blev lurad av en bluff, summan var 1 250 000 kr.",
    "Du kommer ångra dig om du inte betala genast. Knark, heroin och vapen.",
    "Styrelsen\nVD\nEva Strand\nRevisor Carl Dahl\nMaja Norr\n",
    "koppling mellan Erik Ek och Sara Lund. Svarta pengar genom ett skalbolag, penningtvätt och hawala.",
    "Jag är rädd. Polisen talar om mord, utpressning och sprängning ikväll.",
    "transaktion från Alfa till Beta, 45,50 SEK eller 12 mkr. Bitcoin och splitta betalningar.",
    "Det är en bra och fantastisk dag med glad framgång för den som har tid.",
    "This is a note from the board for you and that is all.",
    "Olle Norr är gift med Maja Norr. Hells Angels och bandidos.",
    "Per Holm arbetar på Storbanken Norra Sverige. En id-kapning och ett bedrägeri, ett bedrägeri till.",
)
NOTED = f"SELECT doc_id, CASE doc_id % {len(NOTES) + 1} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(NOTES)) + " ELSE '' END || ' ' || coalesce(text, '') AS text FROM documents"
WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"
#: Every mark that is no word character twice, so that patterns can take up one on either side of a word.
SPACED = f"regexp_replace(text, '([^{WORD}])', '\\1\\1', 'g')"


def noted(t):
    return t.sql(NOTED)


def spaced(x: str) -> str:
    return x.replace(" ", "  ").replace("-", "--")


def hits(words):
    return "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words) + ")"


def score(words):
    return f"least(1.0, 2 * ln({hits(words)} + 1) / ln({len(words) + 1}))"


SCORES = {"fear": ls.FEAR_WORDS, "violence": ls.VIOLENCE_WORDS, "urgency": ls.URGENCY_WORDS, "threat": ls.THREAT_WORDS}
GOOD, BAD = hits(ls.POSITIVE_WORDS), hits(ls.NEGATIVE_WORDS)
FELT = f"felt AS (SELECT *, least(1.0, violence * 0.35 + threat * 0.30 + fear * 0.20 + urgency * 0.15) AS risk FROM (SELECT doc_id, {', '.join(f'{score(v)} AS {k}' for k, v in SCORES.items())}, coalesce(({GOOD} - {BAD}) / nullif({GOOD} + {BAD}, 0), 0) AS polarity FROM noted))"


def found(category, words):
    choice = "|".join(spaced(w) for w in words)
    listed = ", ".join(f"('{spaced(w)}', '{w}', '{v}')" for w, v in words.items())
    return f"""SELECT doc_id, '{category}' AS category, l.word, l.severity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^{WORD}])({choice})(?:$|[^{WORD}])', 1)) AS hit FROM s) x
 JOIN (VALUES {listed}) l(form, word, severity) ON l.form = lower(x.hit)"""


SEEN = f"s AS (SELECT doc_id, {SPACED} AS text FROM noted), seen AS (" + " UNION ALL ".join(found(k, v) for k, v in ls.VOCABULARY.items()) + ")"
WEIGHT = "CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.2 END"


@query("tx_01_extract", f"WITH noted AS ({NOTED}) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{op.PATTERNS[k][0]}')) AS value FROM noted" for k in ("phone", "email", "money")))
def tx_01(t):
    return op.extract(noted(t), F.to_date(F.lit("2026-01-01")), ["phone", "email", "money"])


@query("tx_02_spans")
def tx_02(t):
    return op.spans(noted(t))


@query("tx_04_sentiment", f"WITH noted AS ({NOTED}), {FELT} SELECT doc_id, {', '.join(f'round({k}, 6) AS {k}' for k in (*SCORES, 'polarity', 'risk'))} FROM felt")
def tx_04(t):
    x = noted(t).select("doc_id", op.sentiment(c("text")).alias("s"))
    return x.select("doc_id", *[F.round(f"s.{k}", 6).alias(k) for k in (*SCORES, "polarity", "risk")])


@query("tx_05_vocabulary", f"WITH noted AS ({NOTED}), {SEEN} SELECT doc_id, category, word, severity, count(*) AS n FROM seen GROUP BY ALL")
def tx_05(t):
    return op.vocabulary_matches(noted(t)).groupBy("doc_id", "category", "word", "severity").agg(F.count("*").alias("n"))


@query("tx_06_threat_risk", f"WITH noted AS ({NOTED}), {SEEN}, w AS (SELECT doc_id, {WEIGHT} AS w FROM seen), r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC) AS k FROM w) SELECT doc_id, round(least(1.0, sum(w / k) / 3), 6) AS risk FROM r GROUP BY doc_id")
def tx_06(t):
    hits_of = op.vocabulary_hits(c("text"))
    x = noted(t).select("doc_id", F.transform(hits_of, lambda m: m["severity"]).alias("levels")).where("size(levels) > 0")
    return x.select("doc_id", F.round(op.threat_risk(c("levels")), 6).alias("risk"))


@query("tx_07_combined_risk", f"""WITH noted AS ({NOTED}), {FELT}, {SEEN}, v AS (SELECT doc_id, avg({WEIGHT}) AS w, bool_or(severity = 'high') AS high FROM seen GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN w IS NULL THEN risk ELSE (risk + w) / 2 END, 6) AS risk, fear > 0.5 OR violence > 0.5 OR threat > 0.5 OR coalesce(high, false) AS flag FROM felt LEFT JOIN v USING (doc_id)""")
def tx_07(t):
    x = noted(t).select("doc_id", op.combined_risk(c("text")).alias("r"))
    return x.select("doc_id", F.round("r.risk", 6).alias("risk"), "r.flag")


@query("tx_08_summary", f"""WITH noted AS ({NOTED}), p AS (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM noted),
u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM p), r AS (SELECT *, sum(len(regexp_split_to_array(part, '\\s+'))) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM u)
SELECT doc_id, coalesce(string_agg(part, ' ' ORDER BY k) FILTER (WHERE upto <= 30), '') AS summary FROM r GROUP BY doc_id""")
def tx_08(t):
    return noted(t).select("doc_id", op.summary(c("text"), 30).alias("summary"))


TITLES = [k for k, _ in ls.ROLES]


@query("tx_09_roles_near_names", f"""WITH noted AS ({NOTED}), p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM noted), l AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS k FROM p),
s AS (SELECT doc_id, k, {SPACED} AS text FROM l), r AS (SELECT doc_id, k, replace(regexp_extract(lower(text), '(?:^|[^{WORD}])({'|'.join(spaced(x) for x in TITLES)})(?:$|[^{WORD}])', 1), '  ', ' ') AS role FROM s),
n AS (SELECT doc_id, k, unnest(regexp_extract_all(text, '(?:^|[^{WORD}])(\\p{{Lu}}\\p{{Ll}}+  \\p{{Lu}}\\p{{Ll}}+)(?:$|[^{WORD}])', 1)) AS name FROM s)
SELECT doc_id, role, replace(name, '  ', ' ') AS name, round(max(0.8 - 0.15 * abs(n.k - r.k)), 6) AS confidence FROM r JOIN n USING (doc_id) WHERE role <> '' AND abs(n.k - r.k) <= 2 GROUP BY ALL""")
def tx_09(t):
    return op.roles_near_names(noted(t), TITLES)


@query("tx_10_tagged_fields", "SELECT page_id AS doc_id, CAST(0 AS INT) AS at, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages WHERE html LIKE '%<title>%'")
def tx_10(t):
    return op.tagged_fields(t.pages, ["title"], "page_id", "html")


PAIRS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS relation, unnest(regexp_extract_all(text, '{q}', 1)) AS subject, unnest(regexp_extract_all(text, '{q}', 2)) AS object FROM noted" for k, ps in ls.RELATION_PATTERNS.items() for p in ps for q in ["(?i)" + p.replace(r"\w", f"[{WORD}]")])


@query("tx_11_relations", f"""WITH noted AS ({NOTED}), p AS ({PAIRS}) SELECT DISTINCT doc_id, relation, subject, object, round(least(0.85, 0.5 + 0.1 * (CAST(length(subject) > 10 AS INT) + CAST(length(object) > 10 AS INT)
 + CAST(contains(subject, ' ') AS INT) + CAST(contains(object, ' ') AS INT))), 6) AS confidence FROM p WHERE length(subject) > 1 AND length(object) > 1""")
def tx_11(t):
    return op.relations(noted(t))


@query("tx_12_language", f"WITH noted AS ({NOTED}) SELECT doc_id, CASE WHEN {hits(ls.LANGUAGE_MARKS['en'])} > {hits(ls.LANGUAGE_MARKS['sv'])} THEN 'en' ELSE 'sv' END AS lang FROM noted")
def tx_12(t):
    return noted(t).select("doc_id", op.language(c("text")).alias("lang"))


@query("tx_13_justification", r"SELECT conv_id, turn, length(trim(text)) >= 10 AND len(list_distinct(string_split(replace(lower(trim(text)), ' ', ''), ''))) >= 3 AND len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: length(w) >= 3)) >= 2 AND NOT regexp_matches(replace(lower(trim(text)), ' ', ''), '^([asdfghjkl]+|[qwertyuiop]+|[zxcvbnm]+|[0-9]+)$') AS ok FROM conversations")
def tx_13(t):
    return t.conversations.select("conv_id", "turn", op.justified(c("text")).alias("ok"))


@query("src_08_html_text", r"SELECT page_id, length(html) > 0 AS has FROM pages")
def src_08(t):
    return t.pages.select("page_id", (F.length(op.html_text(c("html"))) > 0).alias("has"))
