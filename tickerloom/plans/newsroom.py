"""Queries over article normalisation, cleaning, tagging, gating and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.matching import source_weight
from ..functions.numeric import rounded
from ..functions.timing import parse_market, gated_date, seconds_of_day
from ..operators import dedup, normalize as N, scoring, splits, textgen
from ..session import shared_folder
from ..settings import NlpSettings, TAG_PATTERNS
from . import views as V
from .sql import r6, r6_all, weight_case, with_views, words

# Headlines for the tagging queries: no match, one match, several matches, a line break.
PHRASES = (
    "Monsoon update lifts rural demand", "Infosys and Wipro sign a deal", "HDFC Bank vs ICICI Bank margins",
    "state bank of india cuts rates", "Tata Motors exports rise, TCS flat", "Kotak\nsecurities on bharti airtel",
    "adani ports and axis bank", "reliance retail opens stores",
)
MENTIONED = ("INFOSYS", "ICICI", "axis", "kotak", "tcs", "hdfc")
SOURCES = ("context", "legacy", "second")
VOWELS = ("aeiou", "अएइओउ")
LETTERS = ("abcdefghijklmnopqrstuvwxyz ", "".join(chr(0x0915 + i) for i in range(27)))


def _phrase():
    values = F.array(*[F.lit(p) for p in PHRASES])
    return F.concat_ws(" ", F.element_at(values, (F.col("doc_id") % len(PHRASES) + 1).cast("int")), F.col("source"))


def _stamp():
    """Publication time text: 2024 plus an offset in seconds."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.timestamp_add("SECOND", (F.col("doc_id") * 7919 % 2_592_000).cast("int"), base)
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


_PHRASE_SQL = "([" + ", ".join("'" + p.replace("\n", "' || chr(10) || '") + "'" for p in PHRASES) + (
    f"])[doc_id % {len(PHRASES)} + 1] || ' ' || source")
_TS_SQL = "(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 7919 % 2592000))"
_TAG_SQL = "(CASE " + " ".join(
    f"WHEN regexp_matches(headline, '{p}', 'i') THEN '{t}'" for p, t in reversed(TAG_PATTERNS)) + " ELSE '' END)"


def news_gate(spark, sf_dir):
    """Market-close gate on every article."""
    d = V.table(spark, sf_dir, "documents").select("doc_id")
    rows = V.articles(spark, sf_dir, d)
    return rows.select(
        F.col("row_ord"), seconds_of_day("pub_dt").cast("long").alias("second_of_day"),
        gated_date("pub_dt").alias("trade_date"),
    )


def news_zones(spark, sf_dir):
    """Offset-aware and naive time text moved to market wall-clock time, then gated."""
    d = V.table(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("", "Z", "+05:30", "-0400")]), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 17 == 0, "soon").otherwise(F.concat(_stamp(), suffix))
    rows = d.select("doc_id", parse_market(text).alias("market_dt"))
    return rows.select("doc_id", "market_dt", gated_date("market_dt").alias("trade_date"))


def news_dedup_hash(spark, sf_dir):
    return V.unique_news(spark, sf_dir).select("ticker", "row_hash", "row_ord", "doc_id")


def _master_inputs(spark, sf_dir):
    """Three raw news files cut from documents; a quarter of the rows is in two files."""
    d = V.table(spark, sf_dir, "documents").withColumns({
        "headline": _phrase(), "stamp": _stamp(), "ticker": F.concat(F.lit(" "), F.lower("lang"), F.lit(" ")),
        "url": F.when(F.col("doc_id") % 5 != 0, F.concat_ws("/", F.lit("https:/"), "source")),
    })

    def part(i):
        twice = (F.col("doc_id") % 4 == 0) & (F.col("doc_id") % 3 == (i + 2) % 3)
        return d.filter((F.col("doc_id") % 3 == i) | twice)

    blank_some = F.when(F.col("doc_id") % 7 != 0, F.col("headline")).otherwise("  ")
    merged = part(0).select(
        F.concat("stamp", F.lit("Z")).alias("datetime"), "ticker", F.col("headline"), F.col("text").alias("body"),
        "source", "url", "doc_id")
    context = part(1).select(
        F.col("stamp").alias("datetime"),
        F.when(F.col("doc_id") % 2 == 0, "2024-03-01").otherwise("?").alias("trade_date"),
        "ticker", blank_some.alias("headline"), F.col("text").alias("body"), "source", "lang", "url", "doc_id")
    archive = part(2).select(
        F.when(F.col("doc_id") % 11 != 0, F.concat("stamp", F.lit("+00:00"))).alias("datePublished"),
        F.col("ticker").alias("symbol"), "headline", F.col("text").alias("articleBody"), "url", "doc_id")
    return (("a.csv", "merged", merged), ("b.csv", "context", context), ("c.csv", "archive", archive))


def news_merge_dedup(spark, sf_dir):
    """Three layouts in one master table, first copy per url, time, ticker and headline."""
    frames = []
    for order, (name, layout, raw) in enumerate(_master_inputs(spark, sf_dir)):
        rows = N.to_master(raw, name, layout, carry=["doc_id"])
        frames.append(rows.withColumns({"file_ord": F.lit(order), "body": F.md5("body")}))
    master = dedup.merge_masters(frames, order=("file_ord", "doc_id"))
    return master.select(*[c for c in N.MASTER_COLUMNS if c not in ("company", "author")])


def ingest_tagged(spark, sf_dir):
    """Header variants, tagging, cleaning and the merge of three raw sources."""
    d = V.table(spark, sf_dir, "documents").withColumns({"head": _phrase(), "stamp": _stamp()})
    part = [d.filter(F.col("doc_id") % 3 == i) for i in range(3)]
    bad = F.when(F.col("doc_id") % 17 == 0, "n/a")
    raws = (
        part[0].select(F.col("stamp").alias(" Timestamp"), F.col("head").alias("Headline"), F.col("text").alias("Summary")),
        part[1].select(
            F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).alias("Symbol"), F.col("stamp").alias("datePublished"),
            F.col("head").alias("Headline"), F.col("text").alias("articleBody")),
        part[2].select(
            bad.otherwise(F.substring("stamp", 1, 10)).alias("datetime"), F.lit("").alias("ticker"),
            F.col("head").alias("headline"), F.col("text").alias("description")),
    )
    return N.merge_tagged([N.tag_and_clean(r, s, TAG_PATTERNS) for r, s in zip(raws, SOURCES)])


def headline_tagging(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", _phrase().alias("headline"))
    return N.tag_and_clean(d, "x", TAG_PATTERNS).select("doc_id", "ticker")


def tag_coverage(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(_phrase().alias("headline"), F.col("source").alias("origin"))
    tagged = N.tag_and_clean(d, "x", TAG_PATTERNS).withColumn("source", F.col("origin"))
    return N.tag_coverage(tagged)


def clean_text_slice(spark, sf_dir):
    """All line-break rules on whole texts with carriage returns mixed in."""
    d = V.table(spark, sf_dir, "documents")
    noisy = F.concat(F.lit(" \n"), F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n ")), F.lit("\r"))
    t = F.col("noisy")
    return d.select("doc_id", noisy.alias("noisy")).select(
        "doc_id", F.md5(X.drop_breaks(t)).alias("flat"), F.md5(X.newline_to_space(t)).alias("spaced"),
        F.md5(X.tidy(t)).alias("tidy"), X.cut_then_clean(t).alias("cut_first"), X.clean_then_cut(t).alias("clean_first"),
    )


def summary_fallback(spark, sf_dir):
    """Long bodies go through a summariser that fails on some; those and short ones are cut."""
    d = V.table(spark, sf_dir, "documents")

    def first_words(body):
        return F.when(F.col("doc_id") % 3 != 0, F.concat_ws(" ", F.slice(F.split(body, " "), 1, 10)))

    return d.select("doc_id", scoring.summarise_long("text", first_words, limit=500, window=4000).alias("body"))


def lang_ratio(spark, sf_dir):
    """Script share and language label; two thirds of the texts are transliterated first."""
    d = V.table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 4
    moved = (
        F.when(kind == 1, F.translate(F.lower("text"), *VOWELS))
        .when(kind == 2, F.translate(F.lower("text"), *LETTERS))
        .when(kind == 3, F.when(F.col("doc_id") % 8 == 3, "  ").otherwise(F.col("text")))
        .otherwise(F.col("text"))
    )
    rows = d.select("doc_id", moved.alias("t")).withColumn("share", X.devanagari_ratio("t"))
    return rows.select("doc_id", rounded("share").alias("ratio"), X.language_label("t", "share").alias("label"))


def source_weights(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 13 == 0, "Wire DEFAULT feed").otherwise(F.upper("source"))
    return d.select("doc_id", source_weight(name, V.TRUST).alias("weight"))


def article_scores(spark, sf_dir):
    """Scores of every document by its language's word lists."""
    return V.documents_scored(spark, sf_dir).select(
        "doc_id", "row_hash", *[rounded(c).alias(c) for c in ("pos", "neg", "neu")]
    )


def _labelled_texts(spark, sf_dir):
    labels, d = V.table(spark, sf_dir, "labels"), V.table(spark, sf_dir, "documents")
    name = (
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .when(F.col("doc_id") % 10 != 3, "neutral")
    )
    joined = labels.join(d.select("doc_id", "text"), "doc_id")
    return splits.distillation_rows(joined.withColumn("label_name", name))


def distill_sample(spark, sf_dir):
    """Seeded sample of labelled texts (the cap is the operator's parameter)."""
    return splits.seeded_sample(_labelled_texts(spark, sf_dir), "doc_id", NlpSettings().distill_max_samples).select(
        "doc_id", "label_name", F.col("hard_int").cast("long").alias("hard_int"), F.md5("text").alias("text_key")
    )


def label_counts(spark, sf_dir):
    return textgen.label_counts(_labelled_texts(spark, sf_dir))


def headline_mentions(spark, sf_dir):
    """Articles without a ticker column, matched to tickers named in the headline."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", _phrase().alias("headline"))
    return N.filter_tickers(d, MENTIONED).select("doc_id", "ticker")


def score_store(spark, sf_dir):
    """Scores kept in a content-keyed store that is filled in two runs."""
    path = shared_folder(spark, "scores")
    d = V.documents_scored(spark, sf_dir)
    rows = d.select("doc_id", "lang", "row_hash", *[F.col(c).alias(f"{c}_in") for c in ("pos", "neg", "neu")])
    score = F.struct(*[F.col(f"{c}_in").alias(c) for c in ("pos", "neg", "neu")])
    scoring.score_with_store(rows.filter("lang = 'en'"), score, path)
    out = scoring.score_with_store(rows, score, path)
    return out.select("doc_id", *[rounded(c).alias(c) for c in ("pos", "neg", "neu")])


def reordered_scores(spark, sf_dir):
    """A model's probability array mapped to score columns by label name."""
    d = V.documents_scored(spark, sf_dir)
    probs = d.select("doc_id", F.array("neg", "neu", "pos").alias("p"))
    mapped = scoring.reorder_scores("p", ("Negative", "NEUTRAL", "positive"))
    return probs.select("doc_id", *[rounded(mapped[c]).alias(c) for c in ("pos", "neg", "neu")])


def template_generate(spark, sf_dir):
    """Unique template texts over all event ids, all template sets."""
    return textgen.generate(V.table(spark, sf_dir, "events"), "event_id")


def _set_sql(spec: textgen.TemplateSet) -> str:
    n = len(spec.templates)
    pick, stride = [], n
    for name, values in spec.slots.items():
        pick.append((name, f"([{words(values)}])[(event_id // {stride}) % {len(values)} + 1]"))
        stride *= len(values)
    text = f"([{words(spec.templates)}])[event_id % {n} + 1]"
    for name, value in pick:
        text = f"replace({text}, '{{{name}}}', {value})"
    return f"""
        SELECT substr(md5(text), 1, 12) AS id, text, {spec.label} AS label, '{spec.label_name}' AS label_name, '{spec.lang}' AS lang,
               'generated' AS source_type, arg_min(event_id % {n}, event_id) AS seed_template_idx
        FROM (SELECT event_id, {text} AS text FROM events) GROUP BY text"""


def _template_sql() -> str:
    return " UNION ALL ".join(_set_sql(s) for s in textgen.DEFAULT_SETS)


QUERIES = {
    f.__name__: f for f in (
        news_gate, news_zones, news_dedup_hash, news_merge_dedup, ingest_tagged, headline_tagging, tag_coverage,
        clean_text_slice, lang_ratio, source_weights, article_scores, distill_sample, label_counts, template_generate,
        summary_fallback, headline_mentions, score_store, reordered_scores,
    )
}

_PART = "(doc_id % 3 = {i} OR (doc_id % 4 = 0 AND doc_id % 3 = {j}))"
_BASE = f"""
    SELECT doc_id, {_PHRASE_SQL} AS headline, {_TS_SQL} AS stamp, upper(lang) AS ticker, md5(trim(
             replace(replace(text, chr(10), ' '), chr(13), ' '))) AS body, source, lang,
           CASE WHEN doc_id % 5 <> 0 THEN 'https://' || source ELSE '' END AS url FROM documents"""
_NOISY = "' ' || chr(10) || replace(text, '. ', '.' || chr(13) || chr(10) || ' ') || chr(13)"
_LABELLED = """
    SELECT * FROM (
      SELECT doc_id, text, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
                                WHEN doc_id % 10 <> 3 THEN 'neutral' END AS label_name
      FROM labels JOIN documents USING (doc_id)) WHERE label_name IS NOT NULL AND text IS NOT NULL"""

ORACLES = {
    "news_gate": with_views("news", """
        SELECT row_ord, hour(pub_dt) * 3600 + minute(pub_dt) * 60 + second(pub_dt) AS second_of_day, trade_date
        FROM news"""),
    "news_zones": f"""
        SELECT doc_id, m AS market_dt,
               CAST(m AS DATE) + CASE WHEN hour(m) * 3600 + minute(m) * 60 + second(m) >= 55800 THEN 1 ELSE 0 END
                 AS trade_date
        FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN {_TS_SQL}
                WHEN doc_id % 4 = 1 THEN {_TS_SQL} + INTERVAL 330 MINUTE WHEN doc_id % 4 = 2 THEN {_TS_SQL}
                ELSE {_TS_SQL} + INTERVAL 570 MINUTE END AS m FROM documents)""",
    "news_dedup_hash": with_views("unique_news", "SELECT ticker, row_hash, row_ord, doc_id FROM unique_news"),
    "news_merge_dedup": f"""
        WITH base AS ({_BASE}), rows AS (
          SELECT 0 AS f, doc_id, stamp AS datetime, CAST(stamp AS DATE) AS trade_date, ticker, replace(headline, chr(10), ' ') AS
                 headline, body, source, '' AS source_type, 'unknown' AS lang, url, 'a.csv' AS source_file
          FROM base WHERE {_PART.format(i=0, j=2)}
          UNION ALL
          SELECT 1, doc_id, stamp, CASE WHEN doc_id % 2 = 0 THEN DATE '2024-03-01' ELSE CAST(stamp AS DATE) END, ticker,
                 replace(headline, chr(10), ' '), body, source, '', lang, url, 'b.csv'
          FROM base WHERE {_PART.format(i=1, j=0)} AND doc_id % 7 <> 0
          UNION ALL
          SELECT 2, doc_id, stamp, CAST(stamp AS DATE), ticker, replace(headline, chr(10), ' '), body, 'Moneycontrol',
                 'archive', 'en', url, 'c.csv'
          FROM base WHERE {_PART.format(i=2, j=1)} AND doc_id % 11 <> 0)
        SELECT datetime, trade_date, ticker, headline, body, source, source_type, lang, url, '' AS tags, source_file
        FROM rows QUALIFY row_number() OVER (PARTITION BY url, datetime, ticker, headline ORDER BY f, doc_id) = 1""",
    "ingest_tagged": f"""
        WITH base AS (SELECT doc_id, {_PHRASE_SQL} AS headline, {_TS_SQL} AS stamp, lang,
                             replace(text, chr(10), ' ') AS body FROM documents),
        rows AS (
          SELECT stamp AS datetime, {_TAG_SQL} AS ticker, headline, body, 'context' AS source
          FROM base WHERE doc_id % 3 = 0
          UNION ALL
          SELECT stamp, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE {_TAG_SQL} END, headline, body, 'legacy'
          FROM base WHERE doc_id % 3 = 1
          UNION ALL
          SELECT date_trunc('day', stamp), {_TAG_SQL}, headline, body, 'second'
          FROM base WHERE doc_id % 3 = 2 AND doc_id % 17 <> 0)
        SELECT datetime, ticker, replace(headline, chr(10), ' ') AS headline, body, source FROM rows WHERE ticker <> ''""",
    "headline_tagging": f"""
        SELECT doc_id, {_TAG_SQL} AS ticker FROM (SELECT doc_id, {_PHRASE_SQL} AS headline FROM documents)""",
    "tag_coverage": f"""
        SELECT source, count(*) FILTER ({_TAG_SQL} <> '') AS tagged, count(*) AS total
        FROM (SELECT source, {_PHRASE_SQL} AS headline FROM documents) GROUP BY 1""",
    "clean_text_slice": f"""
        SELECT doc_id, md5(replace(replace(t, chr(10), ' '), chr(13), '')) AS flat, md5(replace(t, chr(10), ' ')) AS spaced,
               md5(regexp_replace(replace(replace(t, chr(10), ' '), chr(13), ' '), '^\\s+|\\s+$', '', 'g')) AS tidy,
               replace(replace(substr(t, 1, 500), chr(10), ' '), chr(13), '') AS cut_first,
               substr(replace(replace(t, chr(10), ' '), chr(13), ''), 1, 500) AS clean_first
        FROM (SELECT doc_id, {_NOISY} AS t FROM documents)""",
    "summary_fallback": """
        SELECT doc_id, CASE WHEN length(t) > 150 AND doc_id % 3 <> 0
                            THEN array_to_string(list_slice(string_split(substr(t, 1, 4000), ' '), 1, 10), ' ')
                            ELSE substr(t, 1, 500) END AS body
        FROM (SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), '') AS t FROM documents)""",
    "lang_ratio": f"""
        SELECT doc_id, {r6('r')} AS ratio,
               CASE WHEN trim(t) = '' THEN 'unknown' WHEN r > 0.05 AND r < 0.85 THEN 'hinglish' WHEN r >= 0.85 THEN 'hi'
                    WHEN r > 0.05 THEN 'hinglish' ELSE 'en' END AS label
        FROM (SELECT *, length(regexp_replace(t, '[^\\x{{0900}}-\\x{{097F}}]', '', 'g'))
                          / greatest(length(t), 1)::DOUBLE AS r
              FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN translate(lower(text), '{VOWELS[0]}', '{VOWELS[1]}')
                      WHEN doc_id % 4 = 2 THEN translate(lower(text), '{LETTERS[0]}', '{LETTERS[1]}')
                      WHEN doc_id % 8 = 3 THEN '  ' ELSE text END AS t FROM documents))""",
    "source_weights": f"""
        SELECT doc_id, {weight_case("CASE WHEN doc_id % 13 = 0 THEN 'Wire DEFAULT feed' ELSE source END")} AS weight
        FROM documents""",
    "article_scores": with_views(
        "docs_scored", f"SELECT doc_id, row_hash, {r6_all(('pos', 'neg', 'neu'))} FROM docs_scored"),
    "distill_sample": f"""
        SELECT doc_id, label_name, CASE label_name WHEN 'positive' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS hard_int,
               md5(text) AS text_key
        FROM ({_LABELLED}) ORDER BY md5(doc_id || '-42'), doc_id LIMIT {NlpSettings().distill_max_samples}""",
    "label_counts": f"SELECT label_name, count(*) AS n FROM ({_LABELLED}) GROUP BY 1",
    "template_generate": _template_sql(),
    "headline_mentions": f"""
        SELECT doc_id, ticker FROM (SELECT doc_id, {_PHRASE_SQL} AS headline FROM documents),
               (SELECT unnest([{words(t.upper() for t in MENTIONED)}]) AS ticker)
        WHERE contains(upper(headline), ticker)""",
    "score_store": with_views(
        "docs_scored", f"SELECT doc_id, {r6_all(('pos', 'neg', 'neu'))} FROM docs_scored"),
    "reordered_scores": with_views(
        "docs_scored", f"SELECT doc_id, {r6_all(('pos', 'neg', 'neu'))} FROM docs_scored"),
}
