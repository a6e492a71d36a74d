"""Text, URL and name classifiers as Columns. Catalogs and lists are parameters; patterns are the fixed values below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the rule classes and of ladder directions.
ABOVE = r"(?i)\b(or\s+above|at\s+least|above|greater\s+than|exceed(?:s|ed)?)\b"
BELOW = r"(?i)\b(or\s+below|at\s+most|below|less\s+than|under)\b"
JUDGMENT = r"(?i)\b(substantial(?:ly)?|significant(?:ly)?|credible|consensus|acknowledg(?:e|es|ed)|attribut(?:e|es|ed|ion)|determined\s+by|according\s+to|deemed|considered)\b"
OFFICIAL_ACT = r"(?i)\b(signed\s+into\s+law|officially\s+(?:announc|confirm)|filed\s+with|published\s+by|recorded\s+by|certified\s+by|sworn\s+in|takes?\s+office)\b"
NUMERIC = r"(?i)\b(value|price|rate|temperature|votes?|points?|percent|%|above|below)\b"
# Instrumentation words of the tier classes.
SPORTS = r"(?i)\b(?:sports?|esports|athlete|baseball|basketball|football|hockey|soccer|tennis|golf|golfer|cricket|boxing|wrestling|wrestler|olympics?|super bowl|world cup|stanley cup|mlb|nba|nfl|nhl|wnba|ncaa|cfb|atp|uefa|fifa|ufc|madden)\b"
CRYPTO = r"(?i)\b(?:crypto(?:currency|currencies)?|bitcoin|ethereum|solana|dogecoin|stablecoins?|blockchain|coinbase|binance|btc|eth)\b"


def tier(ticker: Column, category: Column, title: Column, tags: Column, excluded=(), listed=(), exceptions=()) -> Column:
    """excluded (ticker prefixes), instrumentation (sports and crypto) or deployment. ``tags`` is an array."""
    t = F.upper(F.coalesce(ticker, F.lit("")))
    low = F.lower(F.coalesce(title, F.lit("")))
    names = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    out = F.lit(False)
    for p in excluded:
        out = out | t.startswith(p)
    spared = F.lit(False)
    for e in exceptions:
        spared = spared | low.contains(e)
    sports = t.isin(*listed) if listed else F.lit(False)
    sports = sports | (~spared & (F.array_contains(names, "sports") | low.rlike(SPORTS)))
    crypto = F.array_contains(names, "crypto") | low.rlike(CRYPTO)
    instrument = F.coalesce(F.lower(category).isin("sports", "crypto"), F.lit(False)) | sports | crypto
    return F.when(out, "excluded").when(instrument, "instrumentation").otherwise("deployment")


def ladder_direction(subtitle: Column, rules: Column) -> Column:
    """above or below, from the subtitle if it says exactly one, else from the rules."""

    def one(text):
        a, b = F.coalesce(text, F.lit("")).rlike(ABOVE), F.coalesce(text, F.lit("")).rlike(BELOW)
        return F.when(a & ~b, "above").when(b & ~a, "below")

    return F.coalesce(one(subtitle), one(rules))


def ladder_strike(direction: Column, floor: Column, cap: Column) -> Column:
    return F.when((direction == "below") & cap.isNotNull(), cap).otherwise(floor)


def rule_class(rules: Column, floor: Column, cap: Column, expiration: Column) -> Column:
    text = F.coalesce(rules, F.lit(""))
    value = F.lower(F.trim(expiration.cast("string")))
    numeric = floor.isNotNull() | cap.isNotNull() | F.coalesce(~value.isin("", "yes", "no"), F.lit(False))
    return (
        F.when(text.rlike(JUDGMENT), "judgment_or_attribution").when(text.rlike(OFFICIAL_ACT), "official_act").when(numeric | (text.rlike(r"\d") & text.rlike(NUMERIC)), "numeric_objective").otherwise("unclassified")
    )


def host(url: Column) -> Column:
    """Lower-case host without www., or null."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def source_class(sources: Column, data_words=("exchange", "nasdaq", "nyse", "cme", "data", "stat")) -> Column:
    """Class of a JSON list of settlement sources by its hosts: government, exchange_or_data, media_or_other or missing."""
    parsed = F.from_json(sources, "array<struct<url:string>>")
    hosts = F.filter(F.transform(parsed, lambda s: host(s["url"])), lambda h: h.isNotNull() & (h != ""))
    words = "|".join(data_words)
    return (
        F.when(hosts.isNull() | (F.size(hosts) == 0), "missing")
        .when(F.exists(hosts, lambda h: h.rlike(r"\.(gov|mil)$") | h.rlike(r"\.gov\.")), "government")
        .when(F.exists(hosts, lambda h: h.rlike(words)), "exchange_or_data")
        .otherwise("media_or_other")
    )


def host_scores(df: DataFrame, key: str, url: str, catalog: DataFrame, floor: float = 0.3) -> DataFrame:
    """Best catalog entry (suffix, upstream, pit) of each key's hosts; an unknown host takes the floor.

    Every host is exploded to its domain suffixes, so the match is an equi-join.
    """
    labels = F.split(host(F.col(url)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = df.select(key, F.explode_outer(F.when(host(F.col(url)).isNotNull(), suffixes)).alias("suffix"))
    hit = each.join(catalog, "suffix", "left")
    best = hit.groupBy(key).agg(F.max(F.struct("upstream", "pit", "suffix")).alias("_b"))
    return best.select(key, F.coalesce("_b.upstream", F.lit(floor)).alias("upstream"), F.coalesce("_b.pit", F.lit(floor)).alias("pit"))


def target_date(event_ticker: Column) -> Column:
    """Date of a -YYMONDD ending, null if there is none or it is no date."""
    d = F.regexp_extract(event_ticker, r"-(\d{2}[A-Z]{3}\d{2})$", 1)
    turned = F.concat(F.substring(d, 6, 2), F.initcap(F.substring(d, 3, 3)), F.substring(d, 1, 2))
    return F.when(d != "", F.try_to_date(turned, "ddMMMyy"))


def quoted_removed(name: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(name, r'["“”].*?["“”]', " "), r"\s+", " ")), F.lit(""))


def last_name(name: Column, suffixes=("jr", "jr.", "sr", "sr.", "ii", "iii", "iv")) -> Column:
    """Last word that is no generational suffix."""
    words = F.split(F.trim(name), r"\s+")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*suffixes))
    return F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise(F.element_at(words, -1))


def marked_section(text: Column, section_word: str, span: int) -> Column:
    """The ``span`` characters from the first ``section_word`` on, whatever its case; null without one."""
    at = F.locate(section_word, F.lower(text))
    return F.when(at > 0, F.substring(text, at, F.lit(span)))


def mention_signal(entity: Column, text: Column, section_word: str = "cloture", span: int = 4000, near: int = 40) -> Column:
    """HOT (full name, and the surname in the marked section), WARM (full name), CLEAR (no unexplained mention) or UNKNOWN."""
    first, last = F.split(F.trim(entity), r"\s+")[0], last_name(entity)

    def quote(w):
        return F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))

    word = F.concat(F.lit(r"\b"), quote(last), F.lit(r"\b"))
    full = F.when(first == last, word).otherwise(F.concat(F.lit(r"\b"), quote(first), F.lit(rf"\b[\s\S]{{0,{near}}}?"), word))
    section = marked_section(text, section_word, span)
    explained = F.concat(F.lit(r"(?:\bvice\b[\s\S]{0,40}|\b(?:Mr|Mrs|Ms|Messrs|Mses)\.\s{0,3})"), word)
    left = F.regexp_replace(text, explained, F.lit(" "))
    known = entity.isNotNull() & (F.trim(entity) != "") & text.isNotNull() & (text != "")
    return (
        F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN")
        .when(F.call_function("rlike", text, full), F.when(F.coalesce(F.call_function("rlike", section, word), F.lit(False)), "HOT").otherwise("WARM"))
        .when(~F.call_function("rlike", left, word), "CLEAR")
        .otherwise("UNKNOWN")
    )


def session_days(today: Column, deadline: Column, closed: Column) -> Column:
    """Weekdays in [today, deadline) outside the inclusive ranges of ``closed`` (array of struct begin, end)."""
    days = F.when(deadline > today, F.sequence(today, F.date_sub(deadline, 1))).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: (F.weekday(d) < 5) & ~F.exists(closed, lambda r: d.between(r["begin"], r["end"]))))


def station_temperature(raw: Column) -> Column:
    """Degrees Fahrenheit of a '+0261,1' reading (tenths of a degree Celsius, quality); null if missing or rejected."""
    value, quality = F.split(raw, ",")[0], F.try_element_at(F.split(raw, ","), F.lit(2))
    tenths = value.try_cast("int")
    return F.when(tenths.isNotNull() & (F.abs(tenths) != 9999) & ~F.coalesce(quality, F.lit("")).isin("2", "3", "6", "7"), tenths / 10.0 * 9.0 / 5.0 + 32.0)
