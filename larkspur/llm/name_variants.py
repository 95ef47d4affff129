"""Variant spellings of names typed by people.

1. A name becomes lower-case tokens without accents, titles and connectives.
2. Distinct tokens, not rows, are compared: MinHash bands over their padded
   q-grams and what is left of two tokens without the allowed slips propose
   pairs, edit distance verifies them, and a rare token becomes a satellite of
   a frequent one. The number of bands follows from the collision
   curve ``1 - (1 - s**r)**b`` for the wanted recall at similarity s.
3. Each name splits into its core (the token shared by a family) and its
   qualifiers (given names, or the words that say what a place or body is).
   Equal forms collapse, so a name typed a million times is one form.
4. Whole names meet by MinHash bands over the padded q-grams of the core and the
   leading q-grams of the qualifiers, in any order; a band, of a large family
   say, is split by the first letters in the name.
5. Complete forms are star centres. A form with initials, nicknames,
   abbreviations or dropped middle names that meets a centre of its core is
   verified by Monge-Elkan similarity over the qualifiers and joins the best
   centre; if two are equally good it joins none.

Defined results: NULL and blank names are in no set; repeated rows of an id
count once; names without any letter are equal only to themselves; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Words that say what a body or a place is (fixed values).
BODY = set(
    "academy association company foundation hospital institute laboratory library museum railway society university council college school church club "
    "committee ministry department office treaty corporation bank agency union league guild".split()
)
PLACE = set("lake port mount cape saint new north south east west upper lower island isle valley bridge county harbour harbor sea river bay hill city town village".split())
TITLES = set("dr prof professor dame sir rev capt mr mrs ms miss lady lord mme mlle herr frau col gen lt sgt hon st_".split())
JOINING = set("of and for the de la le der die das del place".split())
#: Usual abbreviations (fixed values); others are matched letter by letter.
ABBREVIATED = {
    "mt": "mount", "pt": "port", "st": "saint", "nw": "new", "up": "upper", "vly": "valley", "isl": "island", "is": "island", "isle": "island", "hbr": "harbour", "harbor": "harbour",
    "lk": "lake", "brg": "bridge", "br": "bridge", "cty": "county", "cnty": "county", "co": "company", "inst": "institute", "univ": "university", "uni": "university", "acad": "academy",
    "mus": "museum", "lib": "library", "lab": "laboratory", "hosp": "hospital", "soc": "society", "assn": "association", "assoc": "association", "fdn": "foundation", "fndn": "foundation",
    "rly": "railway", "rwy": "railway", "ry": "railway", "eng": "engineering", "engg": "engineering", "engrg": "engineering", "res": "research", "rsch": "research",
    "hist": "history", "med": "medicine", "nav": "navigation", "navig": "navigation", "stud": "studies", "comm": "commerce",
}
_SPELLED = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})


def tokens(text: str) -> tuple[list[str], bool, str, bool]:
    """Tokens in order, whether a junior, a quoted nickname, and whether the family name came first."""
    quoted = re.search(r"[\"“„]\s*([^\"”“]+?)\s*[\"”“]", text)
    nick = ""
    if quoted:
        nick = quoted.group(1)
        text = text[: quoted.start()] + " " + text[quoted.end() :]
    text = re.sub(r"\(\s*place\s*\)", " ", text, flags=re.I)
    text = re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z]{2})", " ", text)  # words run together
    comma = re.search(r"[,;]", text) is not None
    mixed = re.search(r"[a-z]{2}", text) is not None
    out, junior = [], False
    for raw in re.split(r"[\s,;()/&_-]+", text):
        w = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c))
        letters = re.sub(r"[^A-Za-z0-9]", "", w.lower().translate(_SPELLED)) if w.isascii() or w.lower().translate(_SPELLED).isascii() else re.sub(r"[\W_]", "", w.lower())
        if not letters:
            continue
        if re.search(r"[a-z]", letters):
            letters = letters.translate(str.maketrans("015", "ols"))
        if letters in ("jr", "junior"):
            junior = True
        elif letters in TITLES or letters in JOINING:
            continue
        elif len(letters) > 1 and len(letters) <= 5 and (re.fullmatch(r"(?:[A-Za-z]\.){2,}[A-Za-z]?\.?", w) or (mixed and w.isupper() and w.isalpha())):
            out.extend(letters)  # an acronym is a row of initials
        else:
            # `st` is saint before a name, else perhaps studies
            out.append(letters if letters == "st" and out else ABBREVIATED.get(letters, letters))
    return out, junior, nick.lower(), comma


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands needed for `recall` at `similarity`, from the collision curve."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _grams(word: Column, q: int) -> Column:
    padded = F.concat(F.lit("#" * (q - 1)), word, F.lit("$" * (q - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, F.lit(q))))


def _bands(words: DataFrame, q: int, rows: int, bands: int) -> DataFrame:
    """``w, df, band``: one hash a band of the MinHash signature of a word's q-grams."""
    grams = words.select("w", "df", F.transform(_grams(F.col("w"), q), lambda g: F.xxhash64(g)).alias("g"))

    def minimum(seed: int) -> Column:
        return F.array_min(F.transform("g", lambda h: F.xxhash64(h, F.lit(seed))))

    sig = grams.select("w", "df", F.array(*[minimum(i) for i in range(rows * bands)]).alias("s"))
    parts = F.array(*[F.xxhash64(F.lit(b), *[F.col("s")[b * rows + r] for r in range(rows)]) for b in range(bands)])
    return sig.select("w", "df", F.explode(parts).alias("band"))


def allowed_slips(length: int) -> int:
    return 3 if length >= 9 else 2 if length >= 7 else 1


def remains(word: str) -> set[str]:
    """What is left of a word without up to its allowed slips of letters: words that few slips part have one in common."""
    return {"".join(word[i] for i in keep) for d in range(min(allowed_slips(len(word)), len(word) - 1) + 1) for keep in itertools.combinations(range(len(word)), len(word) - d)}


def _remains(words: DataFrame) -> DataFrame:
    """``w, df, band``: one hash for each of the remains of a word."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b[at : at + 500]
                yield part.assign(left=[sorted(remains(w)) for w in part["w"]]).explode("left")

    return words.select("w", "df").mapInPandas(remove, "w string, df bigint, left string").select("w", "df", F.xxhash64("left").alias("band"))


def word_variants(words: DataFrame, *, q: int = 3, rows: int = 3, similarity: float = 0.5, recall: float = 0.97) -> DataFrame:
    """``w, canon``: words (``w, df``) that are misspellings of a word at least twice as frequent, however frequent they are."""
    long_words = words.where(F.length("w") >= 4)
    bands = bands_for(similarity, recall, rows)
    ratio = F.when(F.length("w") == 4, 10).otherwise(2)  # given names of four letters often differ in one
    rare = _bands(long_words, q, rows, bands).unionByName(_remains(long_words))  # the remains miss no allowed edit, the bands add permuted letters
    usual = long_words.where("df >= 2")
    known = _bands(usual, q, rows, bands).unionByName(_remains(usual)).select(F.col("w").alias("u"), F.col("df").alias("udf"), "band")
    met = rare.join(known, "band").where((F.col("w") != F.col("u")) & (F.col("udf") >= ratio * F.col("df"))).select("w", "df", "u", "udf").distinct()
    far = F.levenshtein("w", "u")
    # two neighbouring letters swapped count as one slip: the letters are the same
    same = F.array_sort(F.split("w", "")) == F.array_sort(F.split("u", ""))
    slips = F.when(same, far - 1).otherwise(far)
    allowed = F.when(F.length("u") >= 9, 3).when(F.length("u") >= 7, 2).otherwise(1)
    near = met.withColumn("slips", slips).where(F.col("slips") <= allowed)
    best = near.groupBy("w").agg(F.max_by("u", F.struct(-F.col("slips"), F.col("udf"), F.col("u"))).alias("canon"))
    # a centre that is a satellite itself passes its own on to its centre; every step doubles the links followed, and no chain has a cycle
    while True:
        best = cut(best)
        again = best.select(F.col("w").alias("canon"), F.col("canon").alias("top"))
        if best.join(again, "canon", "left_semi").isEmpty():
            return best
        best = best.join(again, "canon", "left").select("w", F.coalesce("top", "canon").alias("canon"))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    head = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + head * 0.1 * (1 - jaro)


def _shortens(a: str, b: str) -> bool:
    """Whether `a` is an initial or abbreviation of `b`: same first letter, its letters in order."""
    if len(a) >= len(b) or a[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in a) and (len(a) <= 2 or len(a) <= 5 and b not in ("company", "commerce") or b.startswith(a[:3]))


def _inner(a: str, b: str, other: dict[str, list[str]]) -> float:
    if a == b:
        return 1.0
    if b in other.get(a, ()):
        return 0.97
    if _shortens(a, b):
        return 0.95 if len(a) > 1 else 0.9
    s = _jaro_winkler(a, b)
    return s if s >= 0.9 else 0.5 * s


def monge_elkan(a: list[str], b: list[str], other: dict[str, list[str]] | None = None) -> float:
    """Mean of the best inner similarity of each token of `a`, each token of `b` used once."""
    if not a:
        return 0.0
    left, total = list(b), 0.0
    for x in sorted(a, key=len, reverse=True):
        if not left:
            continue
        y = max(left, key=lambda y: (_inner(x, y, other or {}), y))
        s = _inner(x, y, other or {})
        if s > 0.5:
            left.remove(y)
        total += s
    return total / len(a)


def _name_bands(forms: DataFrame, core: str, q: int, rows: int, bands: int) -> DataFrame:
    """`forms` once for every band and letter: the bands of the MinHash signature of a whole name, each split by the first letters in it.

    A name's q-grams are those of its core and the leading one of every other token, so that initials, nicknames (by the
    letters of what they stand for) and any order of tokens leave most of them as they are.
    """
    lead = F.transform("letters", lambda c: F.concat(F.lit("#" * (q - 1)), c))
    grams = forms.withColumn("g", F.transform(F.array_distinct(F.concat(_grams(F.col(core), q), lead)), lambda g: F.xxhash64(g)))
    def lowest(seed: int) -> Column:
        return F.array_min(F.transform("g", lambda h: F.xxhash64(h, F.lit(seed))))

    sig = grams.withColumn("s", F.array(*[lowest(i) for i in range(rows * bands)])).drop("g")
    parts = F.array(*[F.xxhash64(F.lit(b), *[F.col("s")[b * rows + r] for r in range(rows)]) for b in range(bands)])
    return sig.withColumn("band", F.explode(parts)).withColumn("letter", F.explode(F.array_distinct("letters"))).drop("s", "letters")


def name_sets(
    df: DataFrame, id_col: str, text_col: str, nicknames: DataFrame, least: float = 0.88,
    *, name_q: int = 3, name_rows: int = 3, name_similarity: float = 0.75, name_recall: float = 0.999,
) -> DataFrame:
    """``id, entity``: the set of names each row belongs to. `nicknames` has ``nickname, given_name``.

    Names that share `name_similarity` of their q-grams, which forms of one name do even if an initial stands for a given
    name and a second one is left out, meet in a band with probability `name_recall`.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["id"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [tokens(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "ws": [g[0] for g in got], "junior": [g[1] for g in got], "nick": [g[2] for g in got], "comma": [g[3] for g in got]})

    parsed = cut(rows.mapInPandas(parse, "id string, ws array<string>, junior boolean, nick string, comma boolean").where(F.size("ws") > 0))
    seen = parsed.select("id", "junior", "comma", "nick", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "w"))
    words = seen.groupBy("w").agg(F.count_distinct("id").alias("df"))
    variant = word_variants(words)
    said = cut(seen.join(variant, "w", "left").withColumn("w", F.coalesce("canon", "w")).drop("canon"))

    # what a word is: family names close a person's name and stand in bodies and places
    kinds = F.array(*[F.lit(w) for w in sorted(BODY | PLACE)])
    marked = said.withColumn("is_kind", F.array_contains(kinds, F.col("w")))
    per_name = marked.groupBy("id").agg(F.max("is_kind").alias("any_kind"))
    use = marked.join(per_name, "id").where((F.length("w") >= 4) & ~F.col("is_kind"))
    role = use.groupBy("w").agg(
        F.sum(F.when(~F.col("any_kind") & ((F.col("pos") == 0) == F.col("comma")), 1).otherwise(0)).alias("last"),
        F.sum(F.when(~F.col("any_kind") & ((F.col("pos") == 0) != F.col("comma")), 1).otherwise(0)).alias("first"),
        F.sum(F.when(F.col("any_kind"), 1).otherwise(0)).alias("in_kind"),
        F.count("*").alias("uses"),
    )
    # words of subjects stand in bodies of many families, family names do not: the rarest word of a body is its core
    role = role.withColumn("given", (F.col("first") > F.col("last") + F.col("in_kind")).cast("int"))
    placed = marked.join(role, "w", "left").join(per_name, "id")
    rank = F.struct(
        (F.col("is_kind") | (F.length("w") < 4)).cast("int").alias("k"),
        F.when(F.col("any_kind"), (F.coalesce("last", F.lit(0)) * 5 < F.coalesce("uses", F.lit(1))).cast("int")).otherwise(F.coalesce("given", F.lit(0))).alias("g"),
        F.coalesce("uses", F.lit(0)).alias("u"),
        F.when(F.col("comma"), F.col("pos")).otherwise(-F.col("pos")).alias("p"),
    )
    core = placed.groupBy("id").agg(F.min_by("w", rank).alias("core"), F.min_by("pos", rank).alias("at"))
    quals = said.join(core, "id").where("pos <> at").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "w")))["w"].alias("quals"))
    named = parsed.select("id", "junior", "nick").join(core.select("id", "core"), "id").join(quals, "id", "left").join(per_name, "id")
    named = named.withColumn("quals", F.coalesce("quals", F.array().cast("array<string>")))
    initials = F.size("quals") - F.size(F.filter("quals", lambda w: F.length(w) > 1))
    acronym = (initials >= 3) | ((initials == F.size("quals")) & (initials >= 2))
    body = F.arrays_overlap("quals", F.array(*[F.lit(w) for w in sorted(BODY)])) | acronym
    place = F.arrays_overlap("quals", F.array(*[F.lit(w) for w in sorted(PLACE)]))
    kind = F.when(body, "body").when(place, "place").otherwise("person")
    form = named.select(
        "id", "nick", "core", "junior", kind.alias("kind"),
        # given names keep their order, what a place or body is called does not matter in order
        F.when(kind == "person", F.col("quals")).otherwise(F.sort_array("quals")).alias("quals"),
    ).withColumn("form", F.xxhash64("core", "junior", "kind", "quals"))
    form = cut(form)

    # nicknames: the given table, and those quoted beside a full name
    quoted = form.where("nick <> '' AND kind = 'person' AND size(quals) > 0").select(F.col("nick").alias("nickname"), F.col("quals")[0].alias("given"))
    table = nicknames.select(F.lower("nickname").alias("nickname"), F.lower("given_name").alias("given")).unionByName(quoted).where("given IS NOT NULL")
    table = table.groupBy("nickname").agg(F.collect_set("given").alias("givens"))

    forms = form.groupBy("form").agg(F.first("core").alias("core"), F.first("junior").alias("junior"), F.first("kind").alias("kind"), F.first("quals").alias("quals"), F.count("*").alias("rows"))
    usual = role.select("w", (F.col("uses") >= 2).alias("usual"))
    check = forms.select("form", F.explode("quals").alias("w")).join(usual, "w", "left").join(table.select(F.col("nickname").alias("w"), "givens"), "w", "left")
    is_word = (F.length("w") >= 4) & (F.coalesce("usual", F.lit(False)) | F.array_contains(kinds, F.col("w")))
    check = check.groupBy("form").agg(
        F.min((is_word & F.col("givens").isNull()).cast("int")).alias("whole"),
        F.map_from_entries(F.array_distinct(F.filter(F.collect_list(F.when(F.col("givens").isNotNull(), F.struct("w", "givens"))), lambda x: x.isNotNull()))).alias("other"),
    )
    forms = cut(forms.join(check, "form", "left"))
    # centres: complete forms; of a person's, those with all given names first
    centre = forms.where("whole = 1").select(
        F.col("form").alias("centre"), "core", F.col("junior").alias("cj"), F.col("kind").alias("ck"), F.col("quals").alias("cq"), F.col("rows").alias("cr")
    )
    initials = F.array_union(
        F.transform("quals", lambda w: F.substring(w, 1, 1)),
        F.coalesce(F.flatten(F.transform(F.map_values("other"), lambda g: F.transform(g, lambda w: F.substring(w, 1, 1)))), F.array().cast("array<string>")),
    )
    short = forms.where(~((F.col("whole") == 1) & (F.col("kind") != "person")) | F.col("whole").isNull() | ((F.col("kind") == "person") & (F.size("quals") == 1)))
    number = bands_for(name_similarity, name_recall, name_rows)
    asks = _name_bands(short.withColumn("letters", initials), "core", name_q, name_rows, number)
    gives = centre.withColumns({"letters": F.array_distinct(F.transform("cq", lambda w: F.substring(w, 1, 1))), "name": F.col("core")})
    gives = _name_bands(gives.withColumnRenamed("core", "cc"), "name", name_q, name_rows, number)
    pairs = asks.join(gives, ["band", "letter"]).where(
        (F.col("core") == F.col("cc"))
        & (F.col("form") != F.col("centre"))
        & ((F.col("kind") == F.col("ck")) | (F.col("whole") == 0))  # initials do not tell a place from a person
        & (F.col("junior") == F.col("cj"))
        & ((F.size("cq") == F.size("quals")) | (F.col("ck") == "person") & ((F.size("cq") > F.size("quals")) | (F.length(F.element_at("quals", -1)) == 1)))
    )
    pairs = pairs.dropDuplicates(["form", "centre"]).select("form", "centre", "quals", "cq", F.coalesce("whole", F.lit(0)).alias("whole"), "other")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = []
            for q, c, o in zip(b["quals"], b["cq"], b["other"], strict=True):
                o = {k: list(v) for k, v in (o or {}).items()} if o is not None else {}
                a, b_ = list(q), list(c)
                score.append(monge_elkan(a, b_, o) if len(a) <= len(b_) else monge_elkan(b_, a, o))
            yield pd.DataFrame({"form": b["form"], "centre": b["centre"], "whole": b["whole"], "score": score})

    scored = pairs.mapInPandas(verify, "form bigint, centre bigint, whole int, score double").where(F.col("score") >= least)
    best = Window.partitionBy("form")
    top = scored.withColumn("most", F.max("score").over(best)).where(F.col("score") >= F.col("most") - 1e-9)
    # complete forms without a middle name first, as they are centres of others
    middle = top.where("whole = 1").groupBy("form").agg(F.count("*").alias("c"), F.min("centre").alias("top")).where("c = 1").select(F.col("form").alias("centre"), "top")
    ends = (
        top.join(middle, "centre", "left").groupBy("form").agg(F.count_distinct(F.coalesce("top", "centre")).alias("c"), F.min(F.coalesce("top", "centre")).alias("entity"))
    ).where("c = 1")  # a form as near to two centres stays alone
    ends = ends.select("form", "entity")
    return form.join(ends, "form", "left").select("id", F.coalesce("entity", "form").alias("entity"))


def variant_pairs(sets: DataFrame) -> DataFrame:
    """``hash_id_a, hash_id_b`` of every two rows of one set."""
    a, b = sets.withColumnRenamed("id", "hash_id_a"), sets.withColumnRenamed("id", "hash_id_b")
    return a.join(b, "entity").where("hash_id_a < hash_id_b").select("hash_id_a", "hash_id_b")
