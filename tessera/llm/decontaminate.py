"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Texts are folded to words; windows of WINDOW template words are joined by hash with the benchmark's. A window that has
too few words beside its placeholders is keyed by its words themselves, so number-dense items are found verbatim. Names
are capitalised words; an item's windows are known with their names open and with them spelled out, so a copy in other
casing is found too. Matches on one diagonal (place in the document minus place in the item) are one alignment; in it
each item value must stand for itself or go to one document value, so a question with other numbers or names is caught,
but not a chance meeting of templates. Windows around a slot that doesn't fit are left out. Only DataFrame functions
take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import written

#: Template words of a window, and how many of them at least are words of the text rather than placeholders.
WINDOW, LITERAL = 8, 5
#: An item counts as leaked when so many of its words, or this share of them, are covered by consistent matches.
COVERED, SHARE = 24, 0.5
#: Windows in one part of a text.
PART = 64
#: Benchmark windows up to this number are broadcast (about 40 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000

# Unit words after a number.
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yard yards l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros usd eur cent cents percent degree degrees kmh mph kwh w kw v hz khz mhz ghz kb mb gb tb"

#: Patterns and replacements (backslash groups): separators within numbers, numbers, names, gaps, units.
_DIGITS = [("([0-9])[.,:/-]([0-9])", r"\1\2"), ("([0-9])[.,:/-]([0-9])", r"\1\2"), ("([0-9]+)", r" §n\1 ")]
_NAME = (r"(^|[^\p{L}\p{N}])(\p{Lu}\p{Ll}+)", r"\1§a\2")
_GAP = (r"[^\p{L}\p{N}§]+", " ")
_UNIT = (rf"(§n[0-9]+ )({'|'.join(UNITS.split())})( |$)", r"\1§u\2\3")


def folded(text: Column) -> Column:
    """The text's words in one line; numbers, names and units carry a mark (§n, §a, §u) before their value."""
    swap = lambda text, step: F.regexp_replace(text, step[0], step[1].replace("\\", "$"))
    text = F.replace(text, F.lit("§"), F.lit(" "))
    marked = text
    for step in _DIGITS:
        marked = swap(marked, step)
    plain = lambda text: F.trim(swap(F.lower(swap(text, _NAME)), _GAP))
    return F.when(text.rlike("[0-9]"), swap(plain(marked), _UNIT)).otherwise(plain(text))


def _template(word: Column) -> Column:
    return F.when(word.startswith("§"), F.substring(word, 1, 2)).otherwise(word)


def _named(word: Column) -> Column:
    """The template word with names spelled out."""
    return F.when(word.startswith("§a"), F.substring(word, 3, 1 << 30)).otherwise(_template(word))


def _value(word: Column) -> Column:
    return F.when(word.startswith("§"), F.substring(word, 3, 1 << 30)).otherwise(word)


def _words(rows: DataFrame, *ids: str) -> DataFrame:
    """The ids and the folded words of each text that has any."""
    # A generator stands between folding and what uses it, so that each text is folded once.
    rows = rows.select(*ids, F.explode(F.array(folded(F.col("text")))).alias("line")).filter("line != ''")
    return rows.select(*ids, F.split("line", " ").alias("words"))


def _starts(words: str = "words") -> Column:
    """Places (from 1) where windows begin; a text shorter than a window is one window as a whole."""
    return F.sequence(F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(1)))


def _enough(at: Column, words: str = "words") -> Column:
    """Whether the window holds enough words that are no placeholders; a short text is always keyed by its words."""
    part = F.slice(words, at, WINDOW)
    return (F.size(F.filter(part, lambda w: w.startswith("§"))) <= WINDOW - LITERAL) & (F.size(part) == WINDOW)


def _exact(at: Column, words: str = "words") -> Column:
    return F.xxhash64(F.transform(F.slice(words, at, WINDOW), _value), F.lit(1))


def _document_windows(rows: DataFrame, *ids: str) -> DataFrame:
    """(ids, base, part, at_part, key) of every window of every text, one key each.

    Texts are cut into parts of PART windows, so a window's row carries few words of its text, however long that is.
    """
    bases = F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1)), F.lit(PART))
    cut = F.transform(bases, lambda b: F.struct((b - 1).alias("base"), F.slice("words", b, PART + WINDOW - 1).alias("part")))
    rows = rows.select(*ids, F.inline(cut))
    rows = rows.select(*ids, "base", "part", F.transform("part", lambda w: F.xxhash64(_template(w))).alias("h"))
    keys = F.transform(_starts("part"), lambda i: F.when(_enough(i, "part"), F.xxhash64(F.slice("h", i, WINDOW))).otherwise(_exact(i, "part")))
    return rows.select(*ids, "base", "part", F.posexplode(keys).alias("place", "key"))


def _item_windows(items: DataFrame) -> DataFrame:
    """(item, at, key): each window by its template, its template with names spelled out, and its words."""
    rows = items.select("item", "words", F.transform("words", lambda w: F.xxhash64(_template(w))).alias("h"), F.transform("words", lambda w: F.xxhash64(_named(w))).alias("g"))
    spelled = lambda i: F.size(F.filter(F.slice("words", i, WINDOW), lambda w: w.startswith("§") & ~w.startswith("§a"))) <= WINDOW - LITERAL
    whole = lambda i: F.size(F.slice("words", i, WINDOW)) == WINDOW
    keys = F.transform(_starts(), lambda i: F.array(_exact(i), F.when(_enough(i), F.xxhash64(F.slice("h", i, WINDOW))), F.when(whole(i) & spelled(i), F.xxhash64(F.slice("g", i, WINDOW)))))
    rows = rows.select("item", F.posexplode(keys).alias("at", "keys"))
    return rows.select("item", "at", F.explode("keys").alias("key")).filter("key IS NOT NULL").distinct()


def _identified(docs: DataFrame) -> DataFrame:
    """Rows with id and hash, which tell documents apart: rows with one id (or none) and different texts are several."""
    return docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("hash"), "doc_id", "text")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, hash, doc_id, item_id, covered, item_words, slots, changed) of leaked pairs."""
    run = ["id", "hash", "item", "shift"]
    items = _words(benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL"), "item_id")
    members = items.groupBy("words").agg(F.min("item_id").alias("item"), F.collect_set("item_id").alias("item_ids"))
    members = written(members.withColumn("item_words", F.size("words").cast("long")), "items")
    known = written(_item_windows(members), "benchmark-windows")
    known = F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known
    rows = _identified(docs)
    met = _document_windows(_words(rows, "id", "hash"), "id", "hash").join(known, "key")
    met = met.select("id", "hash", "item", (F.col("base") + F.col("place") - F.col("at")).alias("shift"), "at", F.slice("part", F.col("place") + 1, WINDOW).alias("words"))
    met = written(met.distinct(), "met")
    runs = met.groupBy(*run).agg(F.collect_set("at").alias("ats"))

    # Slots: the placeholders of each matched window against the words that stand there in the document.
    asked = members.select("item", F.posexplode("words").alias("at", "asked")).filter(F.col("asked").startswith("§"))
    words = met.select(*run, F.posexplode("words").alias("k", "said"), "at").select(*run, (F.col("at") + F.col("k")).alias("at"), "said").distinct()
    said = words.join(asked, ["item", "at"])
    kind, mine, theirs = F.substring("asked", 1, 2), _value(F.col("asked")), _value(F.col("said"))
    said = said.filter((kind == F.substring("said", 1, 2)) | (mine == theirs)).select(*run, "at", kind.alias("kind"), mine.alias("asked"), theirs.alias("said"))
    pairs = said.groupBy(*run, "kind", "asked", "said").agg(F.count("*").alias("n"), F.collect_list("at").alias("places"))
    # A value that several others stand for goes with the most frequent one, if one is; the item's own value fits anyhow.
    most = F.array_max(F.transform("ways", lambda w: F.size(w.places)))
    clear = F.size(F.filter("ways", lambda w: F.size(w.places) == F.col("most"))) == 1
    odd = F.filter("ways", lambda w: (w.said != F.col("asked")) & ~((F.size(w.places) == F.col("most")) & F.col("clear")))
    ways = pairs.groupBy(*run, "kind", "asked").agg(F.collect_list(F.struct("said", "n", "places")).alias("ways")).withColumn("most", most).withColumn("clear", clear)
    changed = F.aggregate("ways", F.lit(0).cast("long"), lambda n, w: n + F.when(w.said != F.col("asked"), w.n).otherwise(0))
    ways = ways.select(*run, F.aggregate("ways", F.lit(0).cast("long"), lambda n, w: n + w.n).alias("slots"), changed.alias("changed"), F.flatten(F.transform(odd, lambda w: w.places)).alias("odd"))
    fit = ways.groupBy(*run).agg(F.sum("slots").alias("slots"), F.sum("changed").alias("changed"), F.flatten(F.collect_list("odd")).alias("odd"))
    runs = runs.join(fit, run, "left")
    runs = runs.withColumn("ats", F.when(F.col("odd").isNull(), F.col("ats")).otherwise(F.filter("ats", lambda a: ~F.exists("odd", lambda o: (o >= a) & (o < a + WINDOW))))).filter(F.size("ats") > 0)
    runs = written(runs.select(*run, "ats", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("changed", F.lit(0)).alias("changed")), "runs")
    found = runs.groupBy("id", "hash", "item").agg(F.sum("slots").cast("long").alias("slots"), F.sum("changed").cast("long").alias("changed"))

    # Words of the item under the windows of all its alignments: each window adds those up to the next one's start.
    places = runs.select("id", "hash", "item", F.explode("ats").alias("at")).distinct()
    following = F.lead("at").over(Window.partitionBy("id", "hash", "item").orderBy("at"))
    places = places.join(members.select("item", "item_words", "item_ids"), "item")
    step = F.least(F.lit(WINDOW), F.col("item_words"), F.coalesce(following - F.col("at"), F.lit(WINDOW)))
    covered = places.withColumn("step", step).groupBy("id", "hash", "item").agg(F.sum("step").cast("long").alias("covered"), F.first("item_words").alias("item_words"), F.first("item_ids").alias("item_ids"))
    leaked = (F.col("covered") >= COVERED) | (F.col("covered") >= SHARE * F.col("item_words"))
    return found.join(covered, ["id", "hash", "item"]).filter(leaked).select("id", "hash", F.explode("item_ids").alias("item_id"), "covered", "item_words", "slots", "changed")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaked pairs: doc_id, item_id, covered (places of the item under consistent matches, each once), item_words, slots, changed.

    slots counts placeholders under matched windows and changed those with another value, so changed > 0 is a re-parameterised
    question. Each item of a template is held against the document by its own values; items with the same words are
    reported each. An item under WINDOW words is found where it is a document's whole text. Null and empty texts take
    no part, very long ones are read whole. Rows with one doc_id and different texts are judged one by one, and the pair's
    largest figures are reported; rows with a null doc_id are reported under null. Columns other than the ids and texts
    are not read. An empty table on either side gives no rows. Windows that very many documents share are one row of a
    broadcast table; beyond BROADCAST_WINDOWS they are joined by shuffle, where adaptive execution splits their key.
    """
    found = _found(docs, benchmark)
    names = _identified(docs).select("id", "hash", "doc_id").filter("doc_id IS NULL OR doc_id = 0").distinct()
    # Only id 0 may be a null one.
    found = found.join(names.withColumnRenamed("doc_id", "known"), ["id", "hash"], "left").withColumn("doc_id", F.when(F.col("id") == 0, F.col("known")).otherwise(F.col("id")))
    best = F.max(F.struct("covered", "item_words", "slots", "changed")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.covered", "x.item_words", "x.slots", "x.changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any leak, with all their columns; of rows with one id or none, those whose text leaks go."""
    bad = _found(docs, benchmark).select("id", "hash").distinct()
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_leak_id"), F.xxhash64("doc_id", "text").alias("_leak_hash")]
    bad = bad.withColumnsRenamed({"id": "_leak_id", "hash": "_leak_hash"})
    return docs.select("*", *keys).join(bad, ["_leak_id", "_leak_hash"], "left_anti").select(docs.columns)


def _sql_folded(text: str) -> str:
    swap = lambda text, step: f"regexp_replace({text}, '{step[0]}', '{step[1]}', 'g')"
    out = f"replace({text}, '§', ' ')"
    for step in _DIGITS:
        out = swap(out, step)
    return swap(f"trim({swap(f'lower({swap(out, _NAME)})', _GAP)})", _UNIT)


def oracle_sql() -> str:
    def words(rows: str, key: str) -> str:
        return f"SELECT {key}, string_split(line, ' ') AS words FROM (SELECT {key}, {_sql_folded('text')} AS line FROM {rows} WHERE {key} IS NOT NULL AND text IS NOT NULL) WHERE line <> ''"

    template = "CASE WHEN starts_with(w, '§') THEN substring(w, 1, 2) ELSE w END"
    named = f"CASE WHEN starts_with(w, '§a') THEN substring(w, 3) ELSE {template} END"
    value = "CASE WHEN starts_with(w, '§') THEN substring(w, 3) ELSE w END"
    held = "CASE WHEN starts_with(said, '§') THEN substring(said, 3) ELSE said END"

    def windows(rows: str, key: str, place: str) -> str:
        line = lambda kind, mark: f"'{mark}' || array_to_string(list_transform(part, lambda w: {kind}), ' ')"
        return f"""
            SELECT {key}, {place}, {line(template, 't ')} AS open, {line(named, 't ')} AS spelled, {line(value, 'e ')} AS exact,
                   len(part) = {WINDOW} AND len(list_filter(part, lambda w: starts_with(w, '§'))) <= {WINDOW - LITERAL} AS enough,
                   len(part) = {WINDOW} AND len(list_filter(part, lambda w: starts_with(w, '§') AND NOT starts_with(w, '§a'))) <= {WINDOW - LITERAL} AS plain
            FROM (SELECT {key}, {place}, words[{place} + 1 : {place} + {WINDOW}] AS part
                  FROM (SELECT {key}, words, unnest(range(0, greatest(len(words) - {WINDOW} + 1, 1))) AS {place} FROM {rows}))"""

    return f"""
        WITH texts AS ({words('documents', 'doc_id')}), every AS ({words('benchmark', 'item_id')}),
        items AS (SELECT words, min(item_id) AS item, list(DISTINCT item_id) AS item_ids, len(words) AS item_words FROM every GROUP BY words),
        w AS ({windows('items', 'item', 'spot')}),
        known AS (SELECT item, spot, exact AS key FROM w UNION SELECT item, spot, open FROM w WHERE enough UNION SELECT item, spot, spelled FROM w WHERE plain),
        met AS (SELECT DISTINCT doc_id, item, pos - spot AS shift, spot
                FROM (SELECT doc_id, pos, CASE WHEN enough THEN open ELSE exact END AS key FROM ({windows('texts', 'doc_id', 'pos')})) JOIN known USING (key)),
        asked AS (SELECT * FROM (SELECT item, unnest(words) AS asked, unnest(range(0, len(words))) AS spot FROM items) WHERE starts_with(asked, '§')),
        said AS (SELECT doc_id, unnest(words) AS said, unnest(range(0, len(words))) AS pos FROM texts WHERE doc_id IN (SELECT doc_id FROM met)),
        covering AS (SELECT DISTINCT doc_id, item, shift, spot + unnest(range(0, least({WINDOW}, item_words))) AS spot FROM met JOIN items USING (item)),
        slots AS (
            SELECT doc_id, item, shift, spot, substring(asked, 1, 2) AS kind, substring(asked, 3) AS asked, {held} AS said
            FROM covering JOIN asked USING (item, spot) JOIN said USING (doc_id)
            WHERE pos = spot + shift AND (substring(asked, 1, 2) = substring(said, 1, 2) OR substring(asked, 3) = {held})),
        ways AS (SELECT doc_id, item, shift, kind, asked, said, count(*) AS m FROM slots GROUP BY ALL),
        ranked AS (SELECT *, max(m) OVER (PARTITION BY doc_id, item, shift, kind, asked) AS most FROM ways),
        judged AS (SELECT *, said = asked OR (m = most AND count(*) FILTER (WHERE m = most) OVER (PARTITION BY doc_id, item, shift, kind, asked) = 1) AS fits FROM ranked),
        odd AS (SELECT s.doc_id, s.item, s.shift, s.spot FROM slots s JOIN judged j USING (doc_id, item, shift, kind, asked, said) WHERE NOT fits),
        kept AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM odd o WHERE o.doc_id = m.doc_id AND o.item = m.item AND o.shift = m.shift AND o.spot >= m.spot AND o.spot < m.spot + {WINDOW})),
        counted AS (
            SELECT r.doc_id, r.item, count(s.spot) AS slots, count(s.spot) FILTER (WHERE s.said <> s.asked) AS changed
            FROM (SELECT DISTINCT doc_id, item, shift FROM kept) r LEFT JOIN slots s ON s.doc_id = r.doc_id AND s.item = r.item AND s.shift = r.shift GROUP BY ALL),
        steps AS (SELECT doc_id, item, least({WINDOW}, item_words, coalesce(lead(spot) OVER (PARTITION BY doc_id, item ORDER BY spot) - spot, {WINDOW})) AS step
                  FROM (SELECT DISTINCT doc_id, item, spot FROM kept) JOIN items USING (item)),
        sized AS (SELECT doc_id, item, sum(step) AS covered FROM steps GROUP BY ALL)
        SELECT doc_id, unnest(item_ids) AS item_id, CAST(covered AS BIGINT) AS covered, CAST(item_words AS BIGINT) AS item_words,
               CAST(slots AS BIGINT) AS slots, CAST(changed AS BIGINT) AS changed
        FROM sized JOIN counted USING (doc_id, item) JOIN items USING (item) WHERE covered >= {COVERED} OR covered >= {SHARE} * item_words"""
