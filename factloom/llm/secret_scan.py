"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models.

Fixed patterns find assignments, access keys and long hexadecimal runs. Beside them, tokens of 20
or more key characters are scored by two first-order Markov models over characters, one of random
strings and one of ordinary identifiers, words and rules of one repeated character. Their labelled samples come
from the table itself (`table_samples`: what the patterns found is random, words that different texts share are
ordinary), beside made-up ones that keep small tables and unseen alphabets in place (`labelled_samples`), or from the
caller. A token is a finding if its log-likelihood ratio exceeds `least` and it overlaps no
span of the patterns, whether it has digits or not.

Spans are in code points, end exclusive. Each text is read once and gives its matches with the lengths of
the pieces between them; matches then are rows. Running sums of those lengths give the places, and in
order of place a token is set against the furthest end of the patterns' spans before it and the nearest
start after it, so the work grows with the text and the matches (and their sorting), also in one text.
Only matches and row numbers are shuffled, never texts.

Nulls: a null text is empty and has no spans; a null doc_id is kept as it is. Repeated rows are
scanned each for itself. Ties: a token with a ratio of just `least` is no finding. Very long texts are
taken whole, and so are very long tokens. An empty table gives no rows. Only doc_id and text are read;
clashing further columns do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import store, text_of

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
RANDOM = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
# Words of the documents that may stand for ordinary ones: shorter than any token that is scored.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{2,19}+(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIDE = len(ALPHABET) + 1
MATCHES = "array<struct<kind:int,i:int,gap:int,size:int,counts:boolean,token:string>>"

# Ordinary words for the samples of identifiers.
WORDS = (
    "account address amount answer array author batch buffer button cache class client color column command config content count "
    "create current data date default delete description device document element email error event file filter format group handler "
    "height image index information input internal item language length level license list local location manager message method "
    "model module name network number object option order output package page parameter parent password path position process "
    "profile project property public query random record release request resource response result return schema screen search "
    "section server service session setting size source start state status string summary system table target template test text "
    "thread time title token type update upload user value version view width window world"
).split()
# And words of the other languages of the documents.
SPOKEN = (
    "arbeit aufgabe bedingung beispiel bereich bundes donau dampf eigenschaft entwicklung freund gesellschaft gesundheit geschwindigkeit grund haupt heit "
    "kraftfahrzeug leben lich mensch nachricht recht rinder schaft schiff schule sicherheit sprache stadt steuer ueber ung unternehmen versicherung verwaltung wirtschaft zeit "
    "ancien avant bonheur chambre chose contre developpement eau encore enfant environnement famille gouvernement guerre histoire homme jour maison ment monde "
    "nouveau parole pendant peuple pouvoir quelque question raison semaine toujours travail vers ville "
    "ahora amigo ayuda camino ciudad cuando desarrollo donde empresa entonces escuela espacio gobierno hermano hombre informacion juego lugar mente mujer mundo noche "
    "nuestro palabra persona pueblo quien sociedad tiempo trabajo verdad vida "
    "anti able although because before between consider counter different enough every establish follow government inter ness nothing ology people perhaps "
    "psycho should something their there these thing think though through together under which without would pre tion trans"
).split()


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def labelled_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(text, random): as many made-up random strings as made-up identifiers; `rows` bounds the training set."""
    n = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample:"), n.cast("string")), 256)
    b64 = F.substring(F.base64(F.unhex(digest)), 1, 40)
    keys = F.when(n % 4 == 0, b64).when(n % 4 == 1, F.regexp_replace(b64, "[+/=]", "")).when(n % 4 == 2, F.upper(F.regexp_replace(b64, "[+/=]", ""))).otherwise(F.translate(b64, "+/=", "-_"))
    pick = lambda pool, k: F.get(F.split(F.lit(" ".join(pool)), " "), F.pmod(F.xxhash64(n, F.lit(k)), F.lit(len(pool))).cast("int"))
    parts = [pick(WORDS, k) for k in range(4)]
    spoken = [pick(SPOKEN, k) for k in range(4)]
    rule = F.repeat(pick(ALPHABET, 5), F.lit(20) + F.pmod(n, F.lit(20)).cast("int"))
    camel = F.concat(parts[0], *[F.initcap(p) for p in parts[1:]])
    number = F.pmod(F.xxhash64(n, F.lit(9)), F.lit(3000)).cast("string")
    names = (
        F.when(n % 5 == 1, F.concat(*spoken)).when(n % 5 == 2, F.initcap(F.concat_ws("-", *spoken))).when(n % 25 == 3, rule).when(n % 25 == 8, F.upper(F.concat(*spoken)))
        .when(n % 8 == 0, F.concat_ws("_", *parts)).when(n % 8 == 1, camel).when(n % 8 == 2, F.concat_ws("-", *parts)).when(n % 8 == 3, F.upper(F.concat_ws("_", *parts)))
        .when(n % 8 == 4, F.concat_ws("/", *parts)).when(n % 8 == 5, F.concat(F.concat_ws("_", *parts), F.lit("_"), number)).when(n % 8 == 6, F.concat(*parts))
        .otherwise(F.concat_ws("-", number, F.lpad(F.pmod(n, F.lit(12)).cast("string"), 2, "0"), parts[0], parts[1]))
    )
    half = spark.range(rows // 2)
    return half.select(keys.alias("text"), F.lit(True).alias("random")).unionByName(half.select(names.alias("text"), F.lit(False).alias("random")))


def _share(rows: int, of: int) -> int:
    """The limit of a hash of 30 bits that lets about `rows` of so many through."""
    return int((1 << 30) * min(1.0, rows / max(of, 1)))


def table_samples(docs: DataFrame, matches: DataFrame, start: list[float], sample_rows: int = 4000) -> DataFrame:
    """(text, random) of a table: values that the patterns found, and short words that different texts share.

    Values that the `start` model takes for words (as in `password: necessary`) are left out. Both sides are drawn by
    hash, about `sample_rows` values and the words of about as many documents; only their counts of pairs of
    characters go on. Copies of a text count once, so a key that is copied with its text makes no word.
    """
    at = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30))
    base = F.filter("matches", lambda m: m["counts"] & (m["kind"] < len(KINDS) - 1))
    values = store(matches.select(F.explode(base).alias("m")).select(F.col("m.token").alias("text")).distinct(), "secret-values")
    random = values.where(at(F.col("text")) < _share(sample_rows, values.count())).where(token_score(F.col("text"), start) > 0)
    some = docs.where(at(F.col("doc_id"), F.col("text")) < _share(sample_rows, matches.count()))
    words = some.select(F.xxhash64("text").alias("of"), F.explode(F.array_distinct(F.regexp_extract_all(text_of(docs), F.lit(ORDINARY), F.lit(0)))).alias("text"))
    shared = words.groupBy("text").agg(F.min("of").alias("a"), F.max("of").alias("b")).where("a < b")
    return random.select("text", F.lit(True).alias("random")).unionByName(shared.select("text", F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of every (previous, next) character pair, row by row; 0 stands for the start.

    The counts that reach the driver are bounded by the alphabet: two for each pair of characters.
    """
    at = samples.where("length(text) > 0").select("text", "random", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    letters = F.split(F.lit(",".join(ALPHABET)), ",")
    place = lambda c: F.array_position(letters, c).cast("int")
    prev = F.when(F.col("i") == 1, F.lit(0)).otherwise(place(F.expr("substring(text, i - 1, 1)")))
    pairs = at.select("random", prev.alias("p"), place(F.expr("substring(text, i, 1)")).alias("c")).where("c > 0")
    rows = pairs.groupBy("random", "p", "c").count().collect()
    count = {True: [[0.5] * SIDE for _ in range(SIDE)], False: [[0.5] * SIDE for _ in range(SIDE)]}
    for r in rows:
        count[r["random"]][r["p"]][r["c"]] += r["count"]
    out = []
    for p in range(SIDE):
        sums = {k: sum(count[k][p][1:]) for k in count}
        out += [0.0] + [math.log(count[True][p][c] / sums[True]) - math.log(count[False][p][c] / sums[False]) for c in range(1, SIDE)]
    return out


def _matches(text: Column, pattern: str, kind: int, least: int, group: int | None = None) -> Column:
    """The leftmost matches that do not overlap: number, characters since the match before, own characters, whether it (or its group) has `least`, and that part."""
    p = F.lit(pattern)

    def measured(m: Column) -> Column:
        part = F.regexp_extract_all(text, p, F.lit(group)) if group else m
        both = F.struct(m.alias("m"), part.alias("part"), F.split(text, pattern, -1).alias("gap"))
        one = lambda b: lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(b["gap"], i)).alias("gap"), F.length(x).alias("size"), (F.length(F.get(b["part"], i)) >= least).alias("counts"),
            F.get(b["part"], i).alias("token"),
        )
        return F.when(F.size(m) == 0, F.array().cast(MATCHES)).otherwise(bound(both, lambda b: F.transform(b["m"], one(b))))

    return bound(F.regexp_extract_all(text, p, F.lit(0)), measured)


def token_score(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token: random string against identifier."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    letters = F.split(F.lit(",".join(ALPHABET)), ",")
    chars = F.transform(F.split(token, ""), lambda c: F.array_position(letters, c).cast("int"))
    step = lambda a, c: F.struct(c.alias("p"), (a["s"] + F.coalesce(F.get(table, a["p"] * SIDE + c), F.lit(0.0))).alias("s"))
    return F.aggregate(chars, F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("s")), step, lambda a: a["s"])


def _text_form(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, matches) of every document."""
    text = text_of(docs)
    found = F.concat(_matches(text, ASSIGN, 0, 8, 2), _matches(text, ACCESS, 1, 16), _matches(text, HEX, 2, 32), _matches(text, RANDOM, 3, 20))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("matches"))


def place(table: DataFrame) -> DataFrame:
    """(row, kind, start, end, token, free): the spans that count; free: no span of the patterns overlaps this one."""
    m = table.where(F.size("matches") > 0).select("row", F.explode("matches").alias("x")).select("row", "x.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("size")).where("counts")
    fixed = F.col("kind") < len(KINDS) - 1
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("reach", F.max(F.when(fixed, F.col("end"))).over(before)).withColumn("next", F.min(F.when(fixed, F.col("start"))).over(after))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return m.select("row", "kind", "start", "end", "token", free.alias("free"))


def scan_secrets(docs: DataFrame, samples: DataFrame | None = None, least: float = 10.0, sample_rows: int = 4000) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    samples (text, random), if given, replace those of the table and the made-up ones.
    """
    table = store(find_matches(docs), "secret-matches")
    if samples is None:
        made = labelled_samples(docs.sparkSession)
        samples = made.unionByName(table_samples(docs, table, train(made), sample_rows))
    ratios = train(samples)
    random = len(KINDS) - 1
    finding = F.when(F.col("kind") < random, F.lit(True)).when(F.col("free"), token_score(F.col("token"), ratios) > least).otherwise(F.lit(False))
    spans = place(table).where(finding)
    per = spans.groupBy("row").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    out = table.select("row", "doc_id").join(per, "row", "left")
    count = lambda k: F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}")
    text = lambda c: F.coalesce(_text_form(c), F.lit(""))
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(F.filter("all", lambda x: x["kind"] < random)), 256).alias("base_sha256"), text(F.col("all")).alias("spans"), count("random"),
    )
