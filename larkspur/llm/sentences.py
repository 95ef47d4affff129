"""Sentence boundaries for all scripts.

The rules follow the standard character properties for sentence breaks: a
terminator (``Sentence_Break`` STerm or ATerm) with its closing marks ends a
sentence, unless what follows continues it. To this come suppressed
abbreviations per language, the closing of quotations and brackets, blank lines
as breaks, and, for Thai and Lao, spaces, as they have no terminators.

Defined results: NULL and blank texts give no sentence; a text without any
boundary is one unit; repeated ids count once; offsets count code points of the
whole text; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that do not end a sentence (fixed values: English, German, French, Spanish, Russian, Greek, Hindi, Arabic, Italian, Portuguese, Dutch, Polish, Swedish).
INNER = set(
    "dr mr mrs ms prof rev capt col gen lt sgt hon gov sen rep st mt ft fig figs no nos vol vols pp ch sec ed eds cf vs viz approx e.g i.e eg ie "
    "jan feb mar apr jun jul aug sept sep oct nov dec up pt "
    "nw lk cp mtn nr z b d h z.b d.h ca bzw bsp str hr frl "
    "m mm mme mlle env av p.ex "
    "sr sra srta ud uds aprox pág núm "
    "проф ул им тов гг стр рис см т.е т.н "
    "περ κ π.χ δηλ βλ "
    "डॉ श्री प्रो د أ "
    "abb vgl kap bd ggf sog evtl hrsg "
    "sig sigg dott avv pag pagg cfr "
    "exmo exma "
    "blz mevr dhr bijv "
    "ul św tzw "
    "t.ex bl.a s.k".split()
)
#: Abbreviations that may end a sentence: they do before a capital, a quotation or another script.
OUTER = set(
    "p.m a.m ltd co inc corp bros etc usw itd ecc jr sr. u.k u.s u.s.a m.d ph.d b.a m.a esq г млн млрд μ "
    "soc fdn found lib stud acad mus hosp comm assoc assn inst lab rly ry eng engg res med hist nav vly is univ dept bot tech nat coll".split()
)
#: Words that open sentences, to tell an initial at a sentence's end from one before a surname (fixed values).
OPENERS = set(
    "The A An In On At By After Before During Although While When If Many Members People Nobody It He She They We Did Do Does What Who Why How Where "
    "According Given Insofar This That These There Then Now Der Die Das Ein Eine Wer Was Nr Laut Niemand Le La Les Un Une Qui Quel Personne "
    "El Los Las Nadie M Mme Dr Prof Mr Mrs Rev Capt".split()
)
MONTHS = set("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())

_CLOSE = r"[\"'”’»›」』)\]）】]"
_TOKEN = regex.compile(
    r"(?P<para>[^\S\n]*\n\s*?\n\s*)"
    r"|(?P<span>“[^“”\n]*(?:\n(?!\s*\n)[^“”\n]*)*”|„[^„“”\n]*(?:\n(?!\s*\n)[^„“”\n]*)*[“”]|«[^«»\n]*(?:\n(?!\s*\n)[^«»\n]*)*»|「[^「」\n]*(?:\n[^「」\n]*)*」|『[^『』]*』"
    r"|(?<![\p{L}\p{N}])\"(?=\S)[^\"\n]++(?:\n(?!\s*\n)[^\"\n]*+)*+\"(?!\p{L})"
    r"|\((?:[^()\n]|\n(?!\s*\n))*+\)|（(?:[^（）\n]|\n(?!\s*\n))*+）)"
    r"|(?P<term>[\p{SB=STerm}\p{SB=ATerm}…]+(?:\s?[»]|" + _CLOSE + r")*)"
    r"|(?P<greek>;)"
    r"|(?P<spaced>(?<=[\p{Thai}\p{Lao}\d])[^\S\n]*[ \n][^\S\n]*(?=\S))",
)
_END = regex.compile(r"(?P<t>[\p{SB=STerm}\p{SB=ATerm}…]+)(?:\s?[»]|" + _CLOSE + r")*$")
_STERM = regex.compile(r"[\p{SB=STerm}]")
_WORD_BEFORE = regex.compile(
    r"(?r)(?:[\p{Latin}\p{N}̀-ͯ.'’&-]+|[\p{Cyrillic}.-]+|[\p{Greek}.]+|[\p{Devanagari}\p{M}.]+|[\p{Arabic}.]+)"
)  # of one script, as names are glued to words in scripts without spaces
_LOWER_WORD = regex.compile(r"(?r)(?<![\p{L}\p{N}.])(?:\p{Ll}{3,}|\d{3,})")
_NAME_END = regex.compile(r"(?r)(?<![\p{L}.])\p{Lu}\p{Ll}{4,}")
_NEXT_WORD = regex.compile(r"\p{L}+")
_GREEK = regex.compile(r"\p{Greek}")
_SPACED = regex.compile(r"[\p{Thai}\p{Lao}]")
_INDEX = regex.compile(r"\s*\d+:")
_SPACE = regex.compile(r"\s*")


def _goes_on(text: str, at: int) -> bool:
    """Whether the character after a possible end cannot begin a sentence."""
    c = text[at]
    return c.islower() or c in ",;:-–—)]}&?!.…»、，；：" or (c == "と" or text.startswith("って", at))


def _plain_word(pattern: regex.Pattern, text: str, begin: int, dot: int) -> bool:
    """Whether the text before `dot` ends with such a word, no abbreviation."""
    m = pattern.search(text, begin, dot)
    return m is not None and m.end() == dot and m.group().casefold() not in INNER and m.group().casefold() not in OUTER


def _after_dot(text: str, begin: int, dot: int, gap: bool, at: int) -> bool:
    """Whether a lone full stop at `dot`, followed by text at `at`, ends the sentence that began at `begin`."""
    nxt = text[at]
    if not gap:
        if nxt.isdigit() or nxt.islower() or not (nxt.isalpha() or nxt in "“«„「¿¡"):
            return False
        plain = _plain_word(_LOWER_WORD, text, begin, dot)
        if nxt.isupper():
            known = plain or text[dot - 1] in ")”»\"" or _plain_word(_NAME_END, text, begin, dot)
            return known and (text[at + 1 : at + 2].islower() or text[at + 1 : at + 2] in " .")
        return plain
    if nxt.islower():
        return dot - begin >= 4 and _plain_word(_LOWER_WORD, text, begin, dot) and text[dot - 4 : dot].isalnum()
    if _goes_on(text, at) or nxt == "(" and text[at + 1 : at + 2].islower():
        return False
    m = _WORD_BEFORE.search(text, begin, dot)
    if m is None or m.end() != dot:
        return True
    word = m.group()
    key = word.casefold().rstrip(".")
    if nxt.isdigit() and (key in OUTER or key in INNER or len(key) == 1):
        return False
    if key in INNER:
        return False
    if (key in OUTER or len(word) == 1) and nxt.isalpha() and not nxt.isupper():
        return not any(c.isalpha() and not (c.isupper() or c.islower()) for c in text[begin:dot])  # a name inside a script without case
    if key in OUTER:
        return True
    if len(word) == 1 and word.isupper() or (len(word) == 3 and word[1] == "." and word[0].isupper() and word[2].isupper()):
        w = _NEXT_WORD.match(text, at)  # an initial
        return w is None or w.group() in OPENERS or not w.group()[0].isascii()
    if word.isdigit() and len(word) <= 2:
        w = _NEXT_WORD.match(text, at)
        return not (w and w.group() in MONTHS)
    return True


def boundaries(text: str, start: int = 0) -> list[tuple[int, int]]:
    """Offsets of the sentences of `text` from `start` on."""
    out: list[tuple[int, int]] = []
    begin, n = _SPACE.match(text, start).end(), len(text)

    def end(at: int, nxt: int) -> None:
        nonlocal begin
        stop = at
        while stop > begin and text[stop - 1].isspace():
            stop -= 1
        if stop > begin:
            out.append((begin, stop))
        begin = nxt

    for m in _TOKEN.finditer(text, begin):
        kind, j = m.lastgroup, m.end()
        if kind == "para":
            end(m.start(), j)
            continue
        k = _SPACE.match(text, j).end()
        if k >= n:
            continue
        if kind == "spaced":
            left = text[m.start() - 1]
            if left.isdigit():  # a year glued to its word ends a sentence, a measure before its unit does not
                i = m.start() - 1
                while i > begin and (text[i - 1].isdigit() or text[i - 1] in ".,"):
                    i -= 1
                if not (i > begin and _SPACED.match(text, i - 1)):
                    continue
            if text[k].isdigit() or text[k] in "(":
                continue
            end(m.start(), k)
        elif kind == "greek":
            if _GREEK.search(text, begin, m.start()) and not text[k].islower():
                end(j, k)
        elif kind == "span":
            t = _END.search(text, m.start() + 1, j)
            if t is None or _goes_on(text, k):
                continue
            strong = _STERM.search(t.group("t")) is not None
            opens = m.group()[0]
            if opens in "(（":
                if k > j:
                    end(j, k)
            elif m.start() == begin and strong:
                continue  # speech that opens the sentence: its speaker follows
            elif k > j or not text[j].isascii() or opens in "“「『«" and text[j].isupper():
                end(j, k)
        else:
            run = m.group()
            if _STERM.search(run):
                if run[-1] in ")”»“」』\"" and _goes_on(text, k) or (text[k] in ",;:-–—)、，" or text[k] == "と"):
                    continue
                if k == j and text[k].isascii() and not text[k].isupper() and text[k] not in "“\"«¿¡":
                    continue
                end(j, k)
            elif run.startswith("…") or run.startswith(".."):
                if not _goes_on(text, k) and k > j:
                    end(j, k)
            elif len(run) > 1:
                if k > j and not _goes_on(text, k):
                    end(j, k)
            elif _after_dot(text, begin, m.start(), k > j, k):
                end(j, k)
    end(n, n)
    return out


def split_sentences(df: DataFrame, id_col: str, text_col: str, indexed: bool = False) -> DataFrame:
    """``hash_id, sent_start, sent_end`` of every sentence; with `indexed` a leading number and colon belong to none."""
    rows = df.select(F.col(id_col).alias("hash_id"), F.col(text_col).alias("text")).where("hash_id IS NOT NULL AND text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                head = _INDEX.match(t) if indexed else None
                for s, e in boundaries(t, head.end() if head else 0):
                    at.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["hash_id", "sent_start", "sent_end"],
            )

    return rows.dropDuplicates(["hash_id"]).mapInArrow(cut, "hash_id string, sent_start int, sent_end int")
