"""SQL counterparts of the core's queries, composed from named parts."""

from __future__ import annotations

# The settings of the registered queries, written out here so that the SQL stands on its own.
ALPHAS = [round(i * 0.05, 2) for i in range(21)]
ALPHA, PARTNERS, PARTNER_WEIGHT, SIMILAR = 0.5, 5, 0.5, 10
GATE, SENTENCES, PASSAGES, SHARE, RELATED, BOOST = 0.4, 1, 5, 0.05, 0.15, 0.25
DAMPING, STEPS, LEAST, DIM = 0.5, 20, 1e-6, 256
KEYWORDS = ("born", "birth", "where", "when", "located", "location", "founded", "founder", "died", "death", "nationality", "capital", "date", "year")
NAME = r"\p{Lu}[\p{L}\p{M}’']+(?:[ -](?:(?:of|and|the|de|la|der|von) )*\p{Lu}[\p{L}\p{M}’'.]*)*"
FIRST_WORD = r"^([^\p{L}]*)\p{Lu}([\p{L}\p{M}’']*[^\p{L}\p{M}’']+[^\p{Lu}])"
SYSTEM = "Read the passages, reason after `Thought:`, and give the result after `Answer:`."
_SUM = "sum(round({0}, 12)::DECIMAL(38,12))::DOUBLE"


def _words(text: str) -> str:
    unspaced = r"([\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3041}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}])"
    return rf"regexp_extract_all(regexp_replace(replace(lower({text}), 'ς', 'σ'), '{unspaced}', ' \1 ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+')"


PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def _part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = (body, needs)


def _named(name: str, select: str, *needs: str) -> None:
    _part(name, f"{name} AS MATERIALIZED ({select})", *needs)


def _with(select: str, *needs: str) -> str:
    """A query that starts with the parts it needs, each once, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for x in PARTS[n][1]:
                visit(x)
            if n not in order:
                order.append(n)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(PARTS[n][0] for n in order) + "\n" + select


_named("pas", "SELECT DISTINCT hash_id, text FROM passage_embedding WHERE hash_id IS NOT NULL AND text IS NOT NULL")
_named("qs", "SELECT 'question-' || md5(question) AS question_id, question, max(gold_answer) AS answer FROM predictions WHERE question IS NOT NULL GROUP BY question")
_named("ment", "SELECT DISTINCT m.key AS passage_id, e AS entity, 'entity-' || md5(e) AS entity_id FROM (SELECT m, unnest(m.value) AS e FROM (SELECT unnest(map_entries(passage_hash_id_to_entities)) AS m FROM ner_results)) WHERE trim(e) <> ''")
_named("se", "SELECT DISTINCT 'sentence-' || md5(m.key) AS sentence_id, 'entity-' || md5(e) AS entity_id FROM (SELECT m, unnest(m.value) AS e FROM (SELECT unnest(map_entries(sentence_to_entities)) AS m FROM ner_results)) WHERE trim(e) <> ''")
_named("sen", "SELECT DISTINCT 'sentence-' || md5(k) AS sentence_id, k AS text FROM (SELECT unnest(map_keys(sentence_to_entities)) AS k FROM ner_results)")
_named("ent", "SELECT DISTINCT entity_id, entity FROM ment", "ment")
_named("co", "SELECT a.entity_id AS src, b.entity_id AS dst, count(*) AS cnt FROM se a JOIN se b ON a.sentence_id = b.sentence_id AND a.entity_id <> b.entity_id GROUP BY ALL", "se")
_named(
    "pruned",
    "SELECT src, dst, cnt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cnt DESC, dst) AS rn, count(*) OVER (PARTITION BY src) AS n FROM co) WHERE rn <= least(greatest(1, n // 10), 200)",
    "co",
)
_named("vec", "SELECT hash_id, any_value(embedding)::DOUBLE[] AS v FROM entity_embedding WHERE len(embedding) > 0 AND hash_id IS NOT NULL GROUP BY hash_id")
_named(
    "knn",
    "SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM ("
    "SELECT a.hash_id AS src, b.hash_id AS dst, CASE WHEN isnan(s) OR s IS NULL THEN 0 ELSE s END AS sim FROM vec a, vec b, "
    f"LATERAL (SELECT round(list_cosine_similarity(a.v, b.v), 6) AS s) WHERE a.hash_id <> b.hash_id)) WHERE rn <= {SIMILAR}",
    "vec",
)
_named(
    "dense",
    "SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM ("
    "SELECT a.hash_id AS src, b.hash_id AS dst, CASE WHEN isnan(s) OR s IS NULL THEN 0 ELSE s END AS sim FROM vec a, vec b, "
    "LATERAL (SELECT round(list_cosine_similarity(a.v, b.v), 6) AS s) WHERE a.hash_id <> b.hash_id)) "
    "WHERE rn <= greatest(1, least((SELECT count(DISTINCT hash_id) FROM entity_embedding WHERE hash_id IS NOT NULL) // 10, 200))",
    "vec",
)
_k = PARTNERS


def _scaled(name: str, counts: str, co_n: str) -> None:
    _named(
        name,
        f"SELECT src, dst, {co_n} AS co_n, CASE WHEN hi = lo THEN 1.0 ELSE (sim - lo) / (hi - lo) END AS sim_n FROM ("
        "SELECT *, min(cnt) OVER w AS lc, max(cnt) OVER w AS mc, min(sim) OVER w AS lo, max(sim) OVER w AS hi FROM ("
        "SELECT src, dst, coalesce(cnt, 0)::DOUBLE AS cnt, greatest(coalesce(sim, 0), 0)::DOUBLE AS sim FROM "
        f"(SELECT src, dst, cnt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cnt DESC, dst) AS r FROM {counts}) WHERE r <= {_k}) FULL JOIN "
        f"(SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM knn) WHERE r <= {_k}) USING (src, dst)) WINDOW w AS (PARTITION BY src))",
        counts, "knn",
    )


_scaled("scaled", "pruned", "CASE WHEN mc > 0 THEN cnt / mc ELSE 0 END")
_scaled("mscaled", "co", "CASE WHEN mc = lc THEN 1.0 ELSE (cnt - lc) / (mc - lc) END")


def _fused(name: str, alphas: list[float], scaled: str = "scaled") -> None:
    grid = ", ".join(f"({a}::DOUBLE)" for a in alphas)
    _named(
        name,
        "SELECT alpha, src, dst, w, rn FROM (SELECT *, row_number() OVER (PARTITION BY alpha, src ORDER BY w DESC, dst)::INT AS rn FROM ("
        f"SELECT alpha, src, dst, round(alpha * co_n + (1 - alpha) * sim_n, 9) AS w FROM {scaled}, (VALUES {grid}) AS g(alpha)) WHERE w >= {PARTNER_WEIGHT}) WHERE rn <= {_k}",
        scaled,
    )


_fused("fused", [ALPHA])
_fused("mfused", [ALPHA], "mscaled")
_fused("sweep", ALPHAS)
_named(
    "medge",
    "SELECT passage_id, entity_id, coalesce(n / nullif(sum(n) OVER (PARTITION BY passage_id), 0), 0.0)::DOUBLE AS weight FROM ("
    "SELECT passage_id, entity_id, ((length(text) - length(replace(text, entity, ''))) // length(entity))::BIGINT AS n FROM ment JOIN pas ON passage_id = hash_id)",
    "ment", "pas",
)
_named("numbered", r"SELECT hash_id, try_cast(regexp_extract(trim(text), '^(\d+):', 1) AS BIGINT) AS idx FROM pas", "pas")
_named("adj", "SELECT hash_id AS src, nxt AS dst, 1.0::DOUBLE AS weight FROM (SELECT hash_id, lead(hash_id) OVER (ORDER BY idx, hash_id) AS nxt FROM numbered WHERE idx IS NOT NULL) WHERE nxt IS NOT NULL", "numbered")
_named("edge", "SELECT * FROM (SELECT passage_id AS src, entity_id AS dst, weight FROM medge UNION ALL SELECT * FROM adj) WHERE src <> dst AND weight > 0", "medge", "adj")
_named(
    "trans",
    "SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM edge UNION ALL SELECT dst, src, weight FROM edge) GROUP BY ALL)",
    "edge",
)
_name, _first = NAME.replace("'", "''"), FIRST_WORD.replace("'", "''")
_named(
    "qent",
    rf"SELECT DISTINCT question_id, name FROM (SELECT question_id, lower(unnest(regexp_extract_all(regexp_replace(question, '{_first}', '\1x\2'), '{_name}'))) AS name FROM qs) "
    r"WHERE NOT regexp_full_match(name, '\d+(st|nd|rd|th)?')",
    "qs",
)
# the encoder: every word adds its rarity among the passages to one of DIM places, found by its MD5
_named("rarity", f"SELECT b, ln(1 + (SELECT count(*) FROM pas) / count(*)) AS w FROM (SELECT DISTINCT hash_id, ('0x' || substr(md5(t), 1, 4))::INT AS b FROM (SELECT hash_id, unnest({_words('text')}) AS t FROM pas)) GROUP BY b", "pas")


def _vectors(name: str, src: str, key: str, text: str) -> None:
    _named(
        name,
        f"SELECT id, list(x / CASE WHEN n = 0 THEN 1 ELSE n END ORDER BY d) AS v FROM (SELECT id, d, x, sqrt(sum(x * x) OVER (PARTITION BY id)) AS n FROM ("
        f"SELECT k.id, k.d, coalesce(x, 0)::DOUBLE AS x FROM (SELECT {key} AS id, unnest(range({DIM})) AS d FROM {src}) k LEFT JOIN ("
        f"SELECT id, ('0x' || substr(h, 5, 6))::INT % {DIM} AS d, sum(CASE WHEN substr(h, 11, 1) < '8' THEN 1 ELSE -1 END * coalesce(w, ln(1 + (SELECT count(*) FROM pas)))) AS x FROM ("
        f"SELECT id, md5(t) AS h FROM (SELECT {key} AS id, unnest({_words(text)}) AS t FROM {src})) LEFT JOIN rarity ON b = ('0x' || substr(h, 1, 4))::INT GROUP BY ALL) USING (id, d))) GROUP BY id",
        src, "rarity", "pas",
    )


_named("names", "SELECT DISTINCT name FROM qent", "qent")
for _n, _src, _key, _text in (("ent", "ent", "entity_id", "entity"), ("name", "names", "name", "name"), ("q", "qs", "question_id", "question"), ("sen", "sen", "sentence_id", "text"), ("pas", "pas", "hash_id", "text")):
    _vectors(f"{_n}_x", _src, _key, _text)
_named("name_s", "SELECT n.id AS name, e.id AS entity_id, round(list_inner_product(n.v, e.v), 6) AS sim FROM name_x n, ent_x e", "name_x", "ent_x")
_named(
    "seed",
    "SELECT question_id, entity_id, arg_max(sim, name) AS score FROM qent JOIN ("
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sim DESC, entity_id) AS rn FROM name_s) WHERE rn = 1) USING (name) GROUP BY ALL",
    "qent", "name_s",
)
_named("sen_all", "SELECT q.id AS question_id, s.id AS sentence_id, round(list_inner_product(q.v, s.v), 6) AS sim FROM q_x q, sen_x s", "q_x", "sen_x")
_named("sen_s", f"SELECT * FROM sen_all WHERE sim >= {GATE}", "sen_all")
_named("pas_all", "SELECT q.id AS question_id, p.id AS hash_id, round(list_inner_product(q.v, p.v), 6) AS sim FROM q_x q, pas_x p", "q_x", "pas_x")
_named("pas_s", f"SELECT * FROM pas_all WHERE sim >= {RELATED}", "pas_all")
_named("near", "SELECT question_id, sentence_id, entity_id, sim FROM sen_s JOIN se USING (sentence_id) WHERE sim > 0", "sen_s", "se")
_d, _eta = GATE, SENTENCES
for _h in (1, 2):
    _front = "seed" if _h == 1 else f"front{_h - 1}"
    _used = "" if _h == 1 else f"WHERE NOT EXISTS (SELECT 1 FROM pick{_h - 1} u WHERE u.question_id = near.question_id AND u.sentence_id = near.sentence_id)"
    _named(
        f"pick{_h}",
        f"SELECT question_id, entity_id, score, sentence_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY question_id, entity_id ORDER BY sim DESC, sentence_id) AS rn FROM near JOIN (SELECT question_id, entity_id, score FROM {_front} WHERE score >= {_d}) f USING (question_id, entity_id) {_used}) WHERE rn <= {_eta}",
        "near", _front, *([] if _h == 1 else [f"pick{_h - 1}"]),
    )
    _named(
        f"step{_h}",
        f"SELECT question_id, p.src, p.sentence_id, p.dst, CASE WHEN w IS NULL THEN {_d} ELSE greatest(least(base, w), {_d}) END::DOUBLE AS next FROM ("
        f"SELECT x.question_id, x.entity_id AS src, x.sentence_id, n.entity_id AS dst, score * x.sim AS base FROM pick{_h} x JOIN near n USING (question_id, sentence_id) WHERE score * x.sim >= {_d}) p "
        "LEFT JOIN fused ON fused.src = p.src AND fused.dst = p.dst",
        f"pick{_h}", "near", "fused",
    )
    _named(f"reach{_h}", f"SELECT question_id, dst AS entity_id, arg_max(next, src || sentence_id) AS score FROM step{_h} GROUP BY ALL", f"step{_h}")
    _named(
        f"grow{_h}",
        f"SELECT question_id, dst AS entity_id, arg_min(r.score * w, r.entity_id) AS score FROM reach{_h} r JOIN fused ON fused.src = r.entity_id WHERE r.score * w >= {_d} "
        f"AND NOT EXISTS (SELECT 1 FROM reach{_h} o WHERE o.question_id = r.question_id AND o.entity_id = fused.dst) GROUP BY ALL",
        f"reach{_h}", "fused",
    )
    _named(f"front{_h}", f"SELECT *, {_h + 1} AS tier FROM reach{_h} UNION ALL SELECT *, {_h + 1} FROM grow{_h}", f"reach{_h}", f"grow{_h}")
_named(
    "active",
    "SELECT question_id, entity_id, arg_max(score, tier) AS score, max(tier)::INT AS tier FROM (SELECT question_id, entity_id, score, 1 AS tier FROM seed UNION ALL SELECT * FROM front1 UNION ALL SELECT * FROM front2) GROUP BY ALL",
    "seed", "front1", "front2",
)
_named(
    "evid",
    f"SELECT question_id, entity_id, {_SUM.format('weight')} AS weight FROM (SELECT question_id, entity_id, score AS weight FROM seed UNION ALL SELECT question_id, dst, next FROM step1 UNION ALL SELECT question_id, dst, next FROM step2 UNION ALL SELECT * FROM grow1 UNION ALL SELECT * FROM grow2) GROUP BY ALL",
    "seed", "step1", "step2", "grow1", "grow2",
)
for _h in (1, 2):
    _front = "seed" if _h == 1 else "mscore1"
    _used = "" if _h == 1 else "WHERE NOT EXISTS (SELECT 1 FROM mpick1 u WHERE u.question_id = l.question_id AND u.sentence_id = l.sentence_id)"
    _named(f"mlink{_h}", f"SELECT * FROM near JOIN (SELECT question_id, entity_id, score FROM {_front} WHERE score >= {_d}) f USING (question_id, entity_id)", "near", _front)
    _named(f"mpick{_h}", f"SELECT DISTINCT question_id, sentence_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, entity_id ORDER BY sim DESC, sentence_id) AS rn FROM mlink{_h} l {_used}) WHERE rn <= {_eta}", f"mlink{_h}", *([] if _h == 1 else ["mpick1"]))
    _named(f"mout{_h}", f"SELECT question_id, sentence_id, round(mass * sim, 9) AS out FROM (SELECT question_id, sentence_id, {_SUM.format('score')} AS mass, any_value(sim) AS sim FROM mlink{_h} GROUP BY ALL) JOIN mpick{_h} USING (question_id, sentence_id)", f"mlink{_h}", f"mpick{_h}")
    _named(f"mspread{_h}", f"SELECT question_id, entity_id, {_SUM.format('out')} AS s FROM near JOIN mout{_h} USING (question_id, sentence_id) GROUP BY ALL", "near", f"mout{_h}")
    _named(f"mscore{_h}", f"SELECT * FROM (SELECT question_id, src AS entity_id, {_SUM.format('round(s * w, 9)')} AS score FROM mspread{_h} JOIN mfused ON dst = entity_id GROUP BY ALL) WHERE score > 0", f"mspread{_h}", "mfused")
_named(
    "occ",
    "SELECT hash_id AS passage_id, entity_id, ((length(lower(text)) - length(replace(lower(text), name, ''))) // length(name))::BIGINT AS n "
    "FROM pas JOIN (SELECT entity_id, lower(entity) AS name FROM ent) ON contains(lower(text), name)",
    "pas", "ent",
)
_named("bonus", f"SELECT question_id, passage_id, {_SUM.format('score * ln(1 + n) / greatest(tier, 1)')} AS bonus FROM active JOIN occ USING (entity_id) GROUP BY ALL", "active", "occ")
_kw = ", ".join(f"'{k}'" for k in KEYWORDS)
_overlap = " + ".join(f"(contains(lower(question), '{k}') AND contains(lower(text), '{k}'))::INT" for k in KEYWORDS)
_named(
    "boost",
    f"SELECT question_id, hash_id AS passage_id, {BOOST} * ln(1 + n) AS boost FROM (SELECT s.question_id, s.hash_id, {_overlap} AS n FROM pas_all s JOIN qs USING (question_id) JOIN pas USING (hash_id) "
    rf"WHERE list_has_any(regexp_extract_all(lower(question), '\w+'), [{_kw}])) WHERE n > 0",
    "pas_all", "qs", "pas",
)


def _scores(name: str, sims: str) -> None:
    _named(
        name,
        f"SELECT question_id, passage_id, {SHARE} * (exp(coalesce(near, 0)) + coalesce(bonus, 0)) AS score FROM ("
        "SELECT question_id, hash_id AS passage_id, CASE WHEN hi = lo THEN 1.0 ELSE (greatest(sim, 0) - lo) / (hi - lo) END AS near FROM ("
        f"SELECT *, CASE WHEN count(*) OVER w < (SELECT count(*) FROM pas) THEN 0 ELSE greatest(min(sim) OVER w, 0) END AS lo, max(sim) OVER w AS hi FROM {sims} WINDOW w AS (PARTITION BY question_id))) "
        "FULL JOIN bonus USING (question_id, passage_id)",
        sims, "pas", "bonus",
    )


_named("seeded_s", "SELECT * FROM pas_s SEMI JOIN active USING (question_id)", "pas_s", "active")
_scores("gscore", "seeded_s")


def _ranks(prefix: str, reset: str, least: float = LEAST) -> str:
    """Parts of the unrolled power iteration over `reset` (question_id, id, weight); returns the last one's name."""
    _named(f"{prefix}_v", f"SELECT question_id, id, weight / ({_SUM.format('weight')} OVER (PARTITION BY question_id)) AS mass FROM {reset} WHERE weight > 0".replace("::DOUBLE OVER (PARTITION BY question_id)", " OVER (PARTITION BY question_id))::DOUBLE").replace("(sum(", "((sum("), reset)
    last = f"{prefix}_0"
    _named(last, f"SELECT question_id, id, mass AS rank FROM {prefix}_v", f"{prefix}_v")
    for i in range(1, STEPS + 1):
        _named(f"{prefix}_f{i}", f"SELECT x.question_id, dst AS id, sum(x.rank * p) AS rank FROM {last} x JOIN trans ON src = x.id GROUP BY ALL", last, "trans")
        _named(
            f"{prefix}_{i}",
            f"SELECT question_id, id, sum(rank) AS rank FROM (SELECT question_id, id, rank * {DAMPING} AS rank FROM {prefix}_f{i} UNION ALL "
            f"SELECT question_id, id, mass * (1 - {DAMPING} + {DAMPING} * coalesce(lost, 0)) FROM {prefix}_v LEFT JOIN (SELECT question_id, sum(rank) AS lost FROM {last} ANTI JOIN starts USING (id) GROUP BY ALL) USING (question_id)) GROUP BY ALL HAVING sum(rank) >= {least}",
            f"{prefix}_f{i}", f"{prefix}_v", last, "starts",
        )
        last = f"{prefix}_{i}"
    return last


_named("starts", "SELECT DISTINCT src AS id FROM trans", "trans")
_named("seed_reset", "SELECT question_id, entity_id AS id, score AS weight FROM seed", "seed")
_seed_rank = _ranks("sr", "seed_reset")
_base = SHARE
_named("special", f"SELECT question_id, entity_id AS id, weight FROM evid UNION ALL SELECT question_id, passage_id, score - {_base} FROM gscore WHERE score - {_base} > 0", "evid", "gscore")
_own_rank = _ranks("ow", "special")
_named("even", "SELECT '' AS question_id, hash_id AS id, 1.0::DOUBLE AS weight FROM pas", "pas")
_base_rank = _ranks("ba", "even", 0.0)
_named("mass", f"SELECT question_id, {_SUM.format('weight')} AS total, {_base} * (SELECT count(*) FROM pas) AS tb FROM special GROUP BY ALL", "special", "pas")
_named(
    "withbase",
    f"SELECT o.question_id, o.id, (o.rank * total + coalesce(b.rank, 0) * tb) / (total + tb) AS rank FROM {_own_rank} o JOIN mass USING (question_id) LEFT JOIN {_base_rank} b ON b.id = o.id WHERE o.id IN (SELECT hash_id FROM pas)",
    _own_rank, "mass", _base_rank, "pas",
)
_named(
    "rest",
    f"SELECT question_id, id, rank * tb / (total + tb) AS rank FROM mass, (SELECT id, rank FROM {_base_rank} WHERE id IN (SELECT hash_id FROM pas) ORDER BY rank DESC, id LIMIT {PASSAGES}) b "
    "WHERE NOT EXISTS (SELECT 1 FROM withbase w WHERE w.question_id = mass.question_id AND w.id = b.id)",
    "mass", _base_rank, "withbase",
)
_named(
    "found",
    "SELECT question_id, id AS hash_id, round(rank, 9) AS score FROM withbase UNION ALL SELECT question_id, id, round(rank, 9) FROM rest UNION ALL SELECT question_id, hash_id, sim FROM pas_all ANTI JOIN active USING (question_id)",
    "withbase", "rest", "pas_all", "active",
)
_ws = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_ART = r"(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)"


def _norm(x: str) -> str:
    plain = rf"regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\[-`{{-~]', '', 'g')"
    twice = rf"regexp_replace(regexp_replace({plain}, '{_ART}', '\1 \3', 'g'), '{_ART}', '\1 \3', 'g')"
    return rf"trim(regexp_replace({twice}, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ' ', 'g'), ' ')"


def _blank(x: str) -> str:
    return rf"coalesce(NOT regexp_matches({x}, '[^\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]'), true)"


_one = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pred_id) AS rn FROM predictions) WHERE rn = 1)"
_ledger = f"(SELECT round((pred_id % 21) * 0.05::DOUBLE, 2) AS cooccur_alpha, 5 AS top_k_entity_cooccur, round(avg(llm_accuracy), 6) AS EM, round(avg(contain_accuracy), 6) AS Contain_Acc, 'run' AS result_dir FROM {_one} GROUP BY 1)"

SQL: dict[str, str] = {
    "passage_index": r"SELECT DISTINCT hash_id, try_cast(regexp_extract(trim(text), '^(\d+):', 1) AS BIGINT) AS idx FROM passage_embedding",
    "passage_hash": "SELECT doc_id, 'passage-' || md5(doc_id::VARCHAR || ':' || text) AS hash_id FROM documents WHERE text IS NOT NULL",
    "distinct_entities": _with("SELECT * FROM ment", "ment"),
    "sentence_entities": _with("SELECT * FROM se", "se"),
    "label_filter": r"SELECT hash_id, count(*) AS kept FROM (SELECT hash_id, unnest(string_split(text, ' ')) AS w FROM passage_embedding) WHERE w <> '' AND NOT regexp_full_match(w, '\d+(st|nd|rd|th)?') GROUP BY hash_id",
    "cooccur_counts": _with("SELECT * FROM co", "co"),
    "cooccur_pruned": _with("SELECT * FROM pruned", "pruned"),
    "entity_knn": _with("SELECT src, dst, sim::DOUBLE AS sim FROM knn", "knn"),
    "dense_neighbors": _with("SELECT src, dst, sim::DOUBLE AS sim FROM dense", "dense"),
    "link_sparsity": _with(
        "SELECT name, filled, sources, targets, round(filled / nullif(sources::DOUBLE * targets, 0), 9) AS share FROM ("
        "SELECT 'mentions' AS name, count(*) AS filled, count(DISTINCT passage_id) AS sources, count(DISTINCT entity_id) AS targets FROM ment "
        "UNION ALL SELECT 'sentence_entities', count(*), count(DISTINCT sentence_id), count(DISTINCT entity_id) FROM se "
        "UNION ALL SELECT 'cooccurrence', count(*), count(DISTINCT src), count(DISTINCT dst) FROM co)",
        "ment", "se", "co",
    ),
    "fused_neighbors": _with("SELECT * FROM fused", "fused"),
    "alpha_sweep_neighbors": _with("SELECT * FROM sweep", "sweep"),
    "neighbor_stats": _with(
        "SELECT alpha, count(*) AS entities, count_if(d = 0)::BIGINT AS zero, count_if(d < 5)::BIGINT AS below_5, count_if(d < 10)::BIGINT AS below_10, sum(d)::BIGINT AS links, round(sum(d) / count(*), 6) AS mean_links, "
        "round(100 * count_if(d = 0) / count(*), 6) AS zero_percent, round(100 * count_if(d < 5) / count(*), 6) AS below_5_percent, round(100 * count_if(d < 10) / count(*), 6) AS below_10_percent FROM ("
        "SELECT g.alpha, e.entity_id, count(s.dst) AS d FROM (SELECT DISTINCT entity_id FROM ent) e CROSS JOIN (SELECT DISTINCT alpha FROM sweep) g LEFT JOIN sweep s ON s.alpha = g.alpha AND s.src = e.entity_id GROUP BY ALL) GROUP BY alpha",
        "ent", "sweep",
    ),
    "mention_edges": _with("SELECT passage_id, entity_id, round(weight, 9) AS weight FROM medge", "medge"),
    "adjacent_edges": _with("SELECT * FROM adj", "adj"),
    "graph_vertices": _with("SELECT DISTINCT entity_id AS id, 'entity' AS kind, entity AS content FROM ment UNION ALL SELECT hash_id, 'passage', text FROM pas", "ment", "pas"),
    "graph_edges": _with("SELECT src, dst, round(weight, 9) AS weight FROM edge", "edge"),
    "transition_matrix": _with("SELECT src, dst, round(p, 9) AS p FROM trans", "trans"),
    "question_entities": _with("SELECT * FROM qent", "qent"),
    "seed_entities": _with("SELECT * FROM seed", "seed"),
    "question_sentence_sim": _with("SELECT question_id, sentence_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, sentence_id) AS rn FROM sen_all) WHERE rn <= 10", "sen_all"),
    "dense_topk": _with(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, hash_id) AS rank FROM pas_all) WHERE rank <= {PASSAGES}", "pas_all"),
    "hop1_semantic": _with("SELECT question_id, src, sentence_id, dst, round(next, 9) AS next FROM step1", "step1"),
    "hop1_structural": _with("SELECT question_id, entity_id, round(score, 9) AS score FROM grow1", "grow1"),
    "propagate_sync": _with("SELECT question_id, entity_id, round(score, 9) AS score, tier FROM active", "active"),
    "evidence_sync": _with("SELECT question_id, entity_id, round(weight, 9) AS weight FROM evid", "evid"),
    "propagate_matrix": _with(
        f"SELECT question_id, entity_id, round(weight, 9) AS weight, round(score, 9) AS score, tier FROM (SELECT question_id, entity_id, {_SUM.format('score')} AS weight FROM (SELECT question_id, entity_id, score FROM seed UNION ALL SELECT * FROM mscore1 UNION ALL SELECT * FROM mscore2) GROUP BY ALL) LEFT JOIN ("
        f"SELECT question_id, entity_id, arg_max(score, tier) AS score, max(tier)::INT AS tier FROM (SELECT question_id, entity_id, score, 0 AS tier FROM seed UNION ALL SELECT *, 1 FROM mscore1 WHERE score >= {_d} UNION ALL SELECT *, 2 FROM mscore2 WHERE score >= {_d}) GROUP BY ALL) USING (question_id, entity_id)",
        "seed", "mscore1", "mscore2",
    ),
    "entity_occurrences": _with("SELECT * FROM occ", "occ"),
    "entity_bonus": _with("SELECT question_id, passage_id, round(bonus, 6) AS bonus FROM bonus", "bonus"),
    "passage_scores": _with("SELECT question_id, passage_id, round(score, 6) AS score FROM gscore", "gscore"),
    "attribute_boost": _with("SELECT question_id, passage_id, round(boost, 9) AS boost FROM boost", "boost"),
    "ppr_scores": _with(f"SELECT * FROM (SELECT question_id, id, round(rank, 6) AS rank FROM {_seed_rank}) WHERE rank > 0", _seed_rank),
    "retrieve_topk": _with(
        f"SELECT question_id, rank, hash_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, hash_id) AS rank FROM found) WHERE rank <= {PASSAGES}",
        "found",
    ),
    "retrieval_nested": _with(
        "SELECT question, p AS sorted_passage, s AS sorted_passage_scores, answer AS gold_answer FROM qs LEFT JOIN (SELECT question_id, list(text ORDER BY rank) AS p, list(sim ORDER BY rank) AS s FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, hash_id) AS rank FROM pas_all) JOIN pas USING (hash_id) WHERE rank <= {PASSAGES} GROUP BY question_id) USING (question_id)",
        "qs", "pas_all", "pas",
    ),
    "normalize_answer": f"SELECT pred_id, {_norm('pred_answer')} AS normal FROM predictions",
    "contain_accuracy": f"SELECT pred_id, CASE WHEN {_blank('pred_answer')} OR {_blank('gold_answer')} THEN 0 ELSE contains({_norm('pred_answer')}, {_norm('gold_answer')})::INT END AS contain FROM predictions",
    "extract_answer": f"SELECT pred_id, CASE WHEN contains(pred_answer, 'Answer:') THEN trim(string_split(pred_answer, 'Answer:')[2], {_ws}) ELSE pred_answer END AS answer FROM predictions WHERE pred_answer IS NOT NULL",
    "judge_verdict": f"SELECT pred_id, CASE WHEN v = 'correct' THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN v IN ('correct', 'incorrect') THEN v ELSE 'error_answer:' || v END AS verdict FROM (SELECT pred_id, lower(trim(llm_judge_answer, {_ws})) AS v FROM predictions WHERE llm_judge_answer IS NOT NULL)",
    "accuracy_summary": f"SELECT dataset_name, count(*) AS rows, round(avg(llm_accuracy) * 100, 6) AS llm_accuracy, round(avg(contain_accuracy) * 100, 6) AS contain_accuracy FROM {_one} GROUP BY dataset_name",
    "pending_rows": "SELECT DISTINCT pred_id FROM predictions WHERE pred_answer IS NULL",
    "failed_rows": "SELECT DISTINCT pred_id, 'pred_answer' AS stage FROM predictions WHERE contains(pred_answer, 'LLM request failed') UNION ALL SELECT DISTINCT pred_id, 'llm_judge_answer' FROM predictions WHERE contains(llm_judge_answer, 'llm request failed') OR contains(llm_judge_answer, 'error_answer')",
    "percent_parse": "SELECT pred_id, coalesce(try_cast(replace(CASE WHEN llm_accuracy IS NULL THEN 'n/a' ELSE (llm_accuracy * 100)::INT::VARCHAR || '%' END, '%', '') AS DOUBLE), 0.0) AS value FROM predictions",
    "best_alpha": f"SELECT * FROM {_ledger} WHERE EM IS NOT NULL AND Contain_Acc IS NOT NULL ORDER BY EM DESC, cooccur_alpha LIMIT 1",
    "alphas_pending": f"SELECT alpha FROM (SELECT round(i * 0.05::DOUBLE, 2) AS alpha FROM range(21) t(i)) WHERE alpha NOT IN (SELECT round(cooccur_alpha, 2) FROM {_ledger} WHERE EM > 0.55)",
    "new_passages_anti": "SELECT DISTINCT 'sentence-' || md5(text) AS hash_id, text FROM (SELECT unnest(map_keys(sentence_to_entities)) AS text FROM ner_results) WHERE 'sentence-' || md5(text) NOT IN (SELECT hash_id FROM sentence_embedding WHERE hash_id IS NOT NULL)",
    "whole_index": rf"SELECT DISTINCT 'passage-' || md5(text) AS passage_id, 'entity-' || md5(e) AS entity_id FROM (SELECT text, unnest(regexp_extract_all(s, '{_name}')) AS e FROM ("
    r"SELECT text, unnest(string_split(regexp_replace(regexp_replace(text, '^\s*\d+:', ''), '([.!?。！？।])\s+|\n\s*\n', '\1' || chr(1), 'g'), chr(1))) AS s FROM passage_embedding WHERE text IS NOT NULL))",
    "merge_union": "SELECT key, array_to_string(list_sort(list(DISTINCT e)), '|') AS entities FROM (SELECT m.key AS key, unnest(m.value) AS e FROM (SELECT unnest(map_entries(passage_hash_id_to_entities)) AS m FROM ner_results)) WHERE trim(e) <> '' GROUP BY key",
    "merge_override": "SELECT key, array_to_string(arg_max(v, (written_at, v)), '|') AS entities FROM (SELECT written_at, m.key AS key, m.value AS v FROM (SELECT written_at, unnest(map_entries(passage_hash_id_to_entities)) AS m FROM ner_results)) GROUP BY key",
    "prompt_messages": f"SELECT pred_id, md5(c) AS content_md5, length(c) AS chars FROM (SELECT pred_id, array_to_string(coalesce(sorted_passage, []), chr(10)) || chr(10) || 'Question: ' || question || chr(10) || 'Thought: ' AS c FROM {_one})",
}
