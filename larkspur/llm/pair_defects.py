"""Broken prompt and response pairs: ordered rules, every triggered defect of each answer.

All rules are column expressions. Two tables learned from the whole collection
support the rule for abrupt endings: its words (of prompts, and of answers
before their last word) and the word pairs on which complete answers end.

Defined results: a NULL answer is pending and has no row; a NULL question has no
language and is copied by no answer; repeated rows give one row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: In rule order; the first of an answer's defects is its main one.
DEFECTS = ("empty", "copies_question", "refusal", "truncated", "other_language")

_INVISIBLE = r"[­​-‏⁠﻿]"
#: Placeholders and failure notices without content (fixed values).
_PLACEHOLDER = (
    r"(?i)^(?:n\s*/?\s*a|none|null|nan|nil|nothing|todo|tbd|unknown|blank|empty|\?+|no response|no output|error|"
    r"(?:llm |model |api |http )?(?:request|call|response|generation|connection)s? (?:failed|error|timed out).*|(?:error|exception)\s*:.*|timed? ?out.*)$"
)
_LABEL = r"(?i)(?:final answer|answer|thought|question|response|result|output|explanation|verdict|antwort|réponse|respuesta|pregunta|frage)"
#: Openings that repeat a question (fixed values).
_LEAD = (
    r"\b(?:you (?:ask|asked|are asking|want to know)|your question(?: is| was)?|the question(?: is| was)?|vous demandez|votre question(?: est)?|"
    r"usted pregunta|me preguntas?|su pregunta(?: es)?|sie fragen|du fragst|ihre frage(?: ist| lautet)?|die frage(?: ist| lautet)?|"
    r"question|thought|answer|response|frage|antwort|pregunta|respuesta|réponse)\b"
)
#: Statements that there is no answer (fixed values).
_NO_ANSWER = r"(?i)^(?:the (?:passages?|context|text|documents?) (?:do(?:es)? not|don['’]t|doesn['’]t) (?:say|state|mention|tell)|not (?:stated|mentioned|given)(?: in the .*)?|unanswerable|no answer(?: found| given)?|cannot be answered)[.!]?$"
#: Phrases of refusals by language (fixed values, by language: English to Arabic, then Italian, Portuguese, Dutch, Polish, Turkish, Korean, Greek, Hindi, Thai).
_REFUSAL = (
    r"(?i)\bi(?:['’]m| am)? (?:can(?:no|['’])?t|cannot|can not|not able|unable|would rather not|must decline|decline|have to decline|don['’]?t have|do not have|refuse|won['’]t|will not)\b"
    r"|\bi(?:['’]m| am) (?:sorry|afraid),? (?:but )?(?:i|no|there|it|that)\b|\b(?:isn['’]t|is not|not) possible for me\b|\b(?:not|n['’]t) enough (?:information|context|evidence)\b"
    r"|\bno answer can be given\b|\bunable to (?:answer|evaluate|assess|judge|determine|say|help|rate)\b|\bmust decline\b|^as an? (?:ai|assistant|evaluator|language model)\b"
    r"|\bcannot (?:answer|assess|judge|rate|evaluate) (?:this|that|the)\b"
    r"|\bkann ich (?:diese|die|ihre|das)?[^.]{0,30}nicht (?:beantworten|sagen|bewerten)|\bliegen mir[^.]{0,40}\bkeine\b|\btut mir leid\b|\bich kann[^.]{0,40}\bnicht\b"
    r"|\bje ne (?:peux|puis|dispose|sais|suis) pas\b|\bje regrette\b|\bje suis désolé|\bil m['’]est impossible\b"
    r"|\bno puedo (?:responder|contestar|evaluar|ayudar|decir)|\bno dispongo de\b|\blo siento\b|\bno tengo (?:acceso|información|suficiente)"
    r"|не могу (?:ответить|сказать|оценить)|у меня нет (?:информации|данных|доступа)|我无法|我不能|無法回答|无法回答|抱歉|回答できません|お答えできません|申し訳|わかりません|لا أستطيع|لا يمكنني|آسف|عذر"
    r"|\bnon (?:posso|sono in grado di) (?:rispondere|dire|valutare|aiutare)|\bmi dispiace\b|\bnão (?:posso|consigo) (?:responder|dizer|avaliar|ajudar)|\bsinto muito\b"
    r"|\bik kan [^.]{0,40}\bniet (?:beantwoorden|zeggen)|\bhet spijt me\b|\bnie mogę (?:odpowiedzieć|ocenić)|\bprzykro mi\b|\bcevap veremiyorum\b|\büzgünüm\b"
    r"|답변할 수 없|대답할 수 없|죄송|δεν μπορώ να (?:απαντήσω|κρίνω)|λυπάμαι|उत्तर नहीं दे सकता|क्षमा करें|ไม่สามารถตอบ|ขออภัย"
)
#: Words on which no text ends (fixed values: English, German, French, Spanish).
_DANGLING = set(
    "the a an of in at by for to from with and or but as which that who whom whose when where because since although while if than into onto upon on is was were "
    "had has been be being its their his her our your this these those such so not between during after before about under over "
    "der die das dem den des ein eine einer einem einen und oder aber von vom im am zum zur mit weil dass daß nachdem für bei aus durch nach als wie wurde "
    "le la les un une du de des et ou mais que qui dont où dans pour par avec sur sous après avant au aux "
    "el los las una unos unas del y o pero en por para con sin sobre después cuando porque al su sus".split()
)
#: Frequent words that tell languages in Latin script apart (fixed values).
_WORDS = {
    "en": "the it was that would and nobody else had were which when who after before is are been his her its they with from to not as by correct incorrect answer said",
    "de": "der die das und nicht ist war wurde weil dass hat es den dem ein eine nach von im jahr antwort lautet niemand laut mit für auf so ich sie richtig falsch korrekt",
    "fr": "le la les et est une du des que qui dans pour car il elle en par fut après conseil réponse registres agit ne pas sur correcte incorrecte faux vrai d l s",
    "es": "el la los las y es una del que en por porque lo fue según respuesta consejo después nadie registros se trata de para con no más correcta incorrecta correcto incorrecto",
}
_QUESTION = {
    "de": r"(?i)^\W*(?:wer|was|wann|wo|warum|wie|welche[rsmn]?|in welche[rm]|hat|haben|wessen)\b",
    "fr": r"(?i)^\W*(?:qui|que|quel(?:le)?s?|quand|où|pourquoi|comment|combien|est-ce|dans quel(?:le)?)\b",
    "es": r"(?i)^\W*(?:¿|quién|qué|cuál|cuándo|dónde|por qué|cómo|cuánt[oa]s?)",
}
#: Questions about words of another language.
_FOREIGN = r"(?i)\b(?:english|french|german|spanish|italian|russian|chinese|japanese|arabic|hindi|greek|thai|latin|portuguese|foreign)\b|\b(?:auf|in) (?:englisch|französisch|russisch|spanisch)|\ben (?:anglais|allemand|russe|espagnol|inglés|alemán|ruso|francés)\b"
#: Scripts beside the Latin one.
_SCRIPTS = (r"\p{IsCyrillic}", r"\p{IsGreek}", r"\p{IsArabic}", r"\p{IsHebrew}", r"\p{IsDevanagari}", r"\p{IsThai}", r"\p{IsHangul}", r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
_WORD = r"[\p{L}\p{M}\p{N}]+"


def _any(words: str) -> str:
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(words.split()) + r")(?![\p{L}\p{N}])"


def tidy(text: Column) -> Column:
    """Without invisible characters and outer white space."""
    return F.regexp_replace(F.regexp_replace(text, _INVISIBLE, ""), r"(?U)^\s+|\s+$", "")


def content(answer: Column) -> Column:
    """An answer without its labels, wrapping tags and quotes, and the reasoning before its last label."""
    t = tidy(F.regexp_replace(answer, r"(?is)</?(?:answer|response|output|p|br)\s*/?>", " "))
    t = F.regexp_replace(t, r"(?is)^.*\b(?:final )?answer\s*:", "")
    t = F.regexp_replace(tidy(t), r"(?is)^(?:" + _LABEL[4:] + r"\s*:\s*)+", "")
    return tidy(t)


def _simple(text: Column) -> Column:
    """Lower-cased words with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, _INVISIBLE, "")), r"[^\p{L}\p{M}\p{N}]+", " "))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _last_two(ws: Column) -> Column:
    return F.concat_ws(" ", F.try_element_at(ws, F.lit(-2)), F.try_element_at(ws, F.lit(-1)))


def _vocabulary(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, proper prefixes of words, and word pairs that end complete texts, from the whole collection."""
    asked = answers.select(F.explode(F.regexp_extract_all(F.lower("question"), F.lit(_WORD), F.lit(0))).alias("w"))
    ws = F.regexp_extract_all(F.lower("body"), F.lit(_WORD), F.lit(0))
    said = answers.select("complete", ws.alias("ws"))
    inner = said.select(F.explode(F.when(F.col("complete"), F.col("ws")).otherwise(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))))).alias("w"))
    words = asked.unionByName(inner).distinct()
    stems = words.where(F.length("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda n: F.substring("w", F.lit(1), n))).alias("w"))
    ends = said.where(F.col("complete") & (F.size("ws") > 1)).select(_last_two(F.col("ws")).alias("pair")).distinct()
    return words, stems.distinct(), ends


def pair_defects(df: DataFrame, key: str, question: str, gold: str, answers: list[str], judge: str | None = None) -> DataFrame:
    """``key, field, defects``: every answer field with at least one defect, the defects in rule order.

    `judge` names the field that is a verdict in English; `error_answer:` before it is not content.
    """
    base = df.select(
        F.col(key).alias("key"), F.col(question).alias("question"), F.col(gold).alias("gold"),
        F.explode(F.array(*[F.struct(F.lit(a).alias("field"), F.col(a).alias("answer")) for a in answers])).alias("x"),
    ).select("key", "question", "gold", "x.field", "x.answer").where("answer IS NOT NULL").distinct()
    verdict = F.col("field") == (judge or "")
    raw = F.when(verdict, F.regexp_replace(F.lower("answer"), r"(?U)^\s*error_answer:", "")).otherwise(F.col("answer"))
    rows = base.withColumn("raw", tidy(raw)).withColumn("body", content(F.col("raw")))
    # reasoning without an answer label: what follows its first sentence
    rows = rows.withColumn(
        "body", F.when(F.col("raw").rlike(r"(?is)^thought\s*:") & ~F.col("raw").rlike(r"(?is)\banswer\s*:"), F.regexp_replace("body", r"(?s)^[\p{IsLatin}\p{N}\p{P}\s]{20,}?[a-z]\.\s+(?=\S)", "")).otherwise(F.col("body"))
    )
    body, q = F.col("body"), F.coalesce("question", F.lit(""))
    bare = F.regexp_replace(body, r"[\s\p{P}\p{S}\p{Z}]+", "")
    empty = (bare == "") | F.regexp_replace(body, r"[\s.!]+$", "").rlike(_PLACEHOLDER) | body.rlike(r"(?i)^" + _LABEL[4:] + r"\s*:?$")

    qs, cs = _simple(q), _simple(F.when(verdict, F.col("raw")).otherwise(F.col("raw")))
    rest = F.trim(F.regexp_replace(F.replace(F.concat(F.lit(" "), cs, F.lit(" ")), F.concat(F.lit(" "), qs, F.lit(" ")), F.lit("  ")), _LEAD, " "))
    rest = F.trim(F.regexp_replace(F.replace(F.concat(F.lit(" "), rest, F.lit(" ")), F.concat(F.lit(" "), qs, F.lit(" ")), F.lit(" ")), _LEAD, " "))
    copies = (qs != "") & F.contains(F.concat(F.lit(" "), cs, F.lit(" ")), F.concat(F.lit(" "), qs, F.lit(" "))) & (rest == "")

    gold_none = F.coalesce(tidy(F.col("gold")).rlike(_NO_ANSWER), F.lit(False))
    own = F.when(F.length(tidy(F.col("gold"))) > 3, F.replace(body, tidy(F.col("gold")), F.lit(" "))).otherwise(body)
    refusal = (own.rlike(_REFUSAL) | (body.rlike(_NO_ANSWER) & ~verdict)) & ~(gold_none & ~verdict)

    complete = body.rlike(r"[.!?。！？।؟][\"'”’»)\]」』“]*$") & ~body.rlike(r"\.\.\.?$|…$")
    unclosed = (
        (_count(body, r"\(") > _count(body, r"\)"))
        | (_count(body, r"\[") > _count(body, r"\]"))
        | (_count(body, "“") > _count(body, "”") + _count(body, "„"))
        | (_count(body, "„") > _count(body, "[“”]"))
        | (_count(body, "«") > _count(body, "»"))
        | (_count(body, "「") > _count(body, "」"))
        | (_count(body, r"\{") > _count(body, r"\}"))
        | ((_count(body, "```") % 2) == 1)
        | ((_count(body, '"') % 2) == 1)
    )
    words = F.regexp_extract_all(F.lower(body), F.lit(_WORD), F.lit(0))
    rows = rows.withColumns(
        {"empty": empty, "copies_question": copies, "refusal": refusal, "complete": complete, "unclosed": unclosed, "ws": words, "own": own}
    ).withColumns({"last": F.try_element_at("ws", F.lit(-1)), "pair": _last_two(F.col("ws"))})
    rows = cut(rows)  # the rules so far are used by the learned tables and by the result
    known, stems, ends = _vocabulary(rows.select("question", "body", "complete"))
    open_ended = ~F.col("complete") & ~F.col("empty")
    hard_stop = body.rlike(r"[,;:–—-]$|…$|\p{L}\s*\.\.\.$")
    full_verdict = body.isin("correct", "incorrect")  # nearly all verdicts: they ask nothing
    short_words = F.when(verdict, ~full_verdict).otherwise(F.size("ws") > 1)
    dangling = open_ended & (F.size("ws") > 1) & F.col("last").isin(*sorted(_DANGLING))
    # only answers that simply stop need the learned tables
    ask = F.when(open_ended & short_words & ~hard_stop & ~dangling & body.rlike(r"\p{L}$"), F.col("last"))
    rows = rows.withColumn("ask", ask).withColumn("ask_pair", F.when(F.col("ask").isNotNull() & (F.size("ws") >= 8) & body.rlike(r"(?<!\p{L})\p{Ll}+$"), F.col("pair")))
    # answers that ask nothing get keys of their own, which match nothing and spread over the tasks
    own_key = F.concat(F.lit("\0"), F.xxhash64("key", "field", "answer").cast("string"))
    rows = rows.withColumns({"k1": F.coalesce("ask", own_key), "k2": F.coalesce("ask_pair", own_key)})
    rows = (
        rows.join(known.select(F.col("w").alias("k1"), F.lit(True).alias("is_word")), "k1", "left")
        .join(stems.select(F.col("w").alias("k1"), F.lit(True).alias("is_stem")), "k1", "left")
        .join(ends.select(F.col("pair").alias("k2"), F.lit(True).alias("is_end")), "k2", "left")
    )
    verdict_cut = verdict & F.col("ask").isNotNull() & F.lit("incorrect").startswith(body) | verdict & F.lit("correct").startswith(body)
    cut_word = F.col("ask").isNotNull() & F.col("is_word").isNull() & F.col("is_stem").isNotNull()
    told = tidy(F.col("gold"))  # stops inside a word of the right answer
    cut_gold = F.coalesce(
        open_ended & (F.length(body) >= 3) & (F.col("field") != gold) & F.startswith(told, body) & F.substring(told, F.length(body), F.lit(2)).rlike(r"^\p{L}\p{L}$"), F.lit(False)
    )
    cut_text = F.col("ask_pair").isNotNull() & F.col("is_end").isNull()
    whole = F.coalesce(body == tidy(F.col("gold")), F.lit(False)) & (F.col("field") != gold)
    truncated = (F.col("unclosed") | hard_stop | dangling | cut_word | cut_gold | cut_text | (verdict_cut & (F.length(body) >= 3))) & ~whole & ~(verdict & full_verdict)

    lang = F.lit("en")
    for name, pattern in _QUESTION.items():
        lang = F.when(q.rlike(pattern), name).otherwise(lang)
    low = F.lower(F.col("own"))
    rows = rows.withColumns(
        {
            "truncated": truncated,
            "lang": F.when(verdict, "en").otherwise(lang),
            "latin": verdict | (_count(q, r"\p{IsLatin}") >= _count(q, r"[\p{L}&&[^\p{IsLatin}]]")),
            "strange": _count(F.col("own"), r"[\p{L}&&[^\p{IsLatin}]]"),
            **{f"hits_{name}": _count(low, _any(words)) for name, words in _WORDS.items()},
        }
    )
    # to a question in another script no language of Latin script is native
    native = F.when(F.col("latin"), F.coalesce(*[F.when(F.col("lang") == name, F.col(f"hits_{name}")) for name in _WORDS])).otherwise(0)
    best = F.greatest(*[f"hits_{name}" for name in _WORDS])
    other_words = (best > native) & (best >= F.when(verdict, 1).otherwise(2))
    # letters of the scripts the question is written in are not strange to it
    known_script = F.lit(0)
    for script in _SCRIPTS:
        known_script = known_script + F.when(q.rlike(script), _count(F.col("own"), script)).otherwise(0)
    other_script = (F.col("strange") >= 2) & (F.col("latin") | (F.col("strange") - known_script >= 2))
    asks_foreign = q.rlike(_FOREIGN) & ~verdict
    other = (other_script | other_words) & ~asks_foreign

    flags = {"empty": F.col("empty"), "copies_question": F.col("copies_question"), "refusal": F.col("refusal"), "truncated": F.col("truncated"), "other_language": other}
    defects = F.array_compact(F.array(*[F.when(F.coalesce(flags[d], F.lit(False)), d) for d in DEFECTS]))
    return rows.select("key", "field", defects.alias("defects")).where(F.size("defects") > 0).distinct()
