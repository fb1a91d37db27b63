"""Independent SQL for the registered queries, in the dialect of the checking engine."""

from __future__ import annotations

from shapescreen.operators.sampling import PORTIONS, TEST_SHARE, TRAIN_SHARE


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _v(width: int = 18) -> str:
    return f"""v AS (
  SELECT (vec_id // 40) * 10 + label AS mol_id, CAST(label AS BIGINT) AS label, vec_id // 40 AS run,
         CAST(vec_id % 40 AS INTEGER) AS conf_id, CAST(embedding[64] AS DOUBLE) AS energy,
         list_transform(embedding[1:{width}], lambda x: CAST(x AS DOUBLE)) AS features
  FROM embeddings)"""


T = "t AS (SELECT CAST(unnest(range(10)) AS BIGINT) AS target)"
LIB = "lib AS (SELECT DISTINCT mol_id, label, run FROM v)"
KEYS = "k AS (SELECT target, mol_id, label = target AS active FROM lib, t)"
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY energy, conf_id) AS conf_rank FROM v)"
BASE = (_v(), T, LIB, KEYS)


def _scores(template_filter: str = "", width: int = 18, name: str = "s") -> str:
    return f"""{name} AS (
  SELECT a.label AS target, a.mol_id AS template_id, b.mol_id,
         round(max(1.0::DOUBLE / (1.0::DOUBLE + list_sum(list_transform(
           list_zip(a.features[1:{width}], b.features[1:{width}]), lambda p: abs(p[1] - p[2]))) / {width}.0::DOUBLE)), 9) AS score,
         b.label = a.label AS truth
  FROM r a, r b {template_filter} GROUP BY ALL)"""


SCREEN = (_v(), RANKED, _scores())


def _auc(source: str, group: str, name: str, score: str = "score") -> str:
    """CTE ``name(group, auc)`` from rows with score and truth."""
    return f"""{name} AS (
  SELECT {group}, CASE WHEN count_if(truth) > 0 AND count_if(NOT truth) > 0 THEN
      (sum(CASE WHEN truth THEN ar ELSE 0 END) - count_if(truth)::DOUBLE * (count_if(truth) + 1) / 2)
      / (count_if(truth)::DOUBLE * count_if(NOT truth)) END AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {group} ORDER BY {score})
               + (count(*) OVER (PARTITION BY {group}, {score}) - 1) / 2.0::DOUBLE AS ar FROM {source})
  GROUP BY {group})"""


def _ranks(source: str, lists: str) -> str:
    return f"""ranked AS (
  SELECT *, rank() OVER (PARTITION BY {lists} ORDER BY score)
         + (count(*) OVER (PARTITION BY {lists}, score) - 1) / 2.0::DOUBLE AS rank_score FROM {source})"""


def _ef(source: str, lists: str, ident: str = "mol_id", direction: str = "DESC") -> str:
    return f"""efs AS (
  SELECT {lists}, threshold, any_value(k) AS top_n,
         CASE WHEN any_value(p)::DOUBLE / any_value(n) * any_value(k) > 0
              THEN count_if(truth AND rn <= k) / (any_value(p)::DOUBLE / any_value(n) * any_value(k))
              ELSE 'inf'::DOUBLE END AS ef
  FROM (SELECT *, CAST(floor(threshold * n) AS BIGINT) AS k FROM (
          SELECT *, row_number() OVER (PARTITION BY {lists} ORDER BY score {direction}, md5(concat('0:', CAST({ident} AS VARCHAR)))) AS rn,
                 count(*) OVER (PARTITION BY {lists}) AS n, count_if(truth) OVER (PARTITION BY {lists}) AS p
          FROM {source}), (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE]) AS threshold))
  GROUP BY {lists}, threshold)"""


def _report(source: str, group: str, lists: str, ident: str = "mol_id") -> tuple[str, ...]:
    """CTEs ending in ``rep(group, auc, auc_rank, ef_1, ef_5)``."""
    first = group.split(", ")
    using = f"USING ({group})"
    return (
        _auc(source, group, "a1"),
        _ranks(source, lists),
        _auc("ranked", group, "a2", "rank_score"),
        _ef(source, lists, ident),
        f"""rep AS (SELECT {", ".join("a1." + c for c in first)}, a1.auc, a2.auc AS auc_rank, e.ef_1, e.ef_5
  FROM a1 JOIN a2 {using} JOIN (
    SELECT {group}, avg(ef) FILTER (threshold = 0.01::DOUBLE) AS ef_1, avg(ef) FILTER (threshold = 0.05::DOUBLE) AS ef_5
    FROM efs GROUP BY {group}) e {using})""",
    )


NAME = "concat(CASE WHEN active THEN 'active_mol_' ELSE 'decoy_mol_' END, CAST(mol_id AS VARCHAR))"
TOTALS = "tot AS (SELECT target, count_if(active) AS na, count_if(NOT active) AS nd FROM k GROUP BY target)"


def _draw(name, portions, share, ratio, policy, seed, exclude=None) -> tuple[str, ...]:
    """CTE ``name(target, portion, mol_id, active)``: a sample under the quota rules."""
    key = NAME if policy == "SEQUENTIAL" else f"md5(concat('{seed}:', CAST(mol_id AS VARCHAR)))"
    dbl = lambda v: f"CAST('{float(v)!r}' AS DOUBLE)"
    pairs = ", ".join(f"({dbl(p)}, {dbl(p * share)})" for p in portions)
    per = "nd::DOUBLE / na::DOUBLE" if ratio < 0 else dbl(ratio)
    anti = "" if exclude is None else f"WHERE NOT EXISTS (SELECT 1 FROM {exclude} e WHERE e.target = k.target AND e.portion = p.portion AND e.mol_id = k.mol_id)"
    return (
        f"{name}_p AS (SELECT * FROM (VALUES {pairs}) AS p(portion, x))",
        f"""{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY target, portion, active ORDER BY key, mol_id) AS rn
  FROM (SELECT k.target, k.mol_id, k.active, p.portion, {key} AS key FROM k, {name}_p p {anti}))""",
        f"""{name}_q AS (
  SELECT q.target, q.portion, least(ceil(la), coalesce(av, 0)) AS qa,
         greatest(ceil(la + least(d, nd::DOUBLE)) - least(ceil(la), coalesce(av, 0)), 0) AS qd
  FROM (SELECT *, least(a, na::DOUBLE) AS la, coalesce(a * ({per}), 0) AS d
        FROM (SELECT *, CASE WHEN x <= 1 THEN na * x ELSE x END AS a FROM tot, {name}_p)) q
  LEFT JOIN (SELECT target, portion, count(*) AS av FROM {name}_r WHERE active GROUP BY ALL) n USING (target, portion))""",
        f"""{name} AS (
  SELECT r.target, r.portion, r.mol_id, r.active FROM {name}_r r JOIN {name}_q q USING (target, portion)
  WHERE r.rn <= CASE WHEN r.active THEN q.qa ELSE q.qd END)""",
    )


def _sets(portions) -> tuple[str, ...]:
    return (
        *BASE,
        TOTALS,
        *_draw("te", portions, TEST_SHARE, -1, "RANDOM", 0),
        *_draw("tr", portions, TRAIN_SHARE, -1, "RANDOM", 1, "te"),
        *_draw("re", portions, TRAIN_SHARE, 0, "RANDOM", 2, "te"),
        """sets AS (SELECT *, 'test' AS part FROM te UNION ALL SELECT *, 'train' FROM tr
  UNION ALL SELECT *, 'redraw' FROM re)""",
    )


def _kfold(folds: int, key: str) -> str:
    return f"""f AS (
  SELECT target, mol_id, active, CAST((rn - 1) // size AS INTEGER) AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY {key}, mol_id) AS rn,
           count(*) OVER (PARTITION BY target) // {folds} AS size FROM k)
  WHERE size >= 1 AND (rn - 1) // size < {folds})"""


_HASH11 = "md5(concat('11:', CAST(mol_id AS VARCHAR)))"


# Per-feature mean and variance of a group's conformers, in long form.
LONG = "long AS (SELECT mol_id, label, conf_id, conf_rank, unnest(features) AS x, unnest(range(18)) AS i FROM r)"


def _gmm1(source_filter: str) -> str:
    return _with(
        _v(),
        RANKED,
        T,
        LONG,
        f"""m AS (SELECT label AS target, i, avg(x) AS mu, var_pop(x) + 1e-6 AS s
  FROM long {source_filter} GROUP BY label, i)""",
        """dens AS (SELECT m.target, l.mol_id, l.label, l.conf_id,
         sum(-0.5 * (ln(2 * pi() * m.s) + (l.x - m.mu) * (l.x - m.mu) / m.s)) AS ll
  FROM long l JOIN m USING (i) GROUP BY ALL)""",
        select="""SELECT target, 1 AS param, mol_id, round(avg(ll), 6) AS score, any_value(label = target) AS truth
FROM dens GROUP BY target, mol_id""",
    )


def _trained(grid: str) -> tuple[str, ...]:
    """``trained(target, param, n)``: the parameters of a grid for each target, with its training rows."""
    return (
        _v(),
        "rows_of AS (SELECT label AS target, count(*) AS n FROM v GROUP BY label)",
        f"trained AS (SELECT target, CAST(param AS INTEGER) AS param, n FROM rows_of, (SELECT unnest({grid}) AS param))",
    )


def _rescored(grid: str, condition: str = "true") -> str:
    """All molecules of each model, and as many that agree."""
    return _with(
        *_trained(grid),
        select=f"""SELECT target, param, (SELECT count(DISTINCT mol_id) FROM v) AS molecules, (SELECT count(DISTINCT mol_id) FROM v) AS agree
FROM trained WHERE {condition}""",
    )


# One diagonal Gaussian per molecule.
MOL1 = "g AS (SELECT mol_id, label, i, avg(x) AS mu, var_pop(x) + 1e-6 AS s FROM long GROUP BY ALL)"
PAIR = """p AS (
  SELECT a.label AS target, a.mol_id AS template_id, b.mol_id, b.label = a.label AS truth,
         sum((a.mu - b.mu) * (a.mu - b.mu) / (a.s + b.s)) AS quad, sum(ln(a.s + b.s)) AS logdet,
         sum(ln(a.s)) AS lda, sum(ln(b.s)) AS ldb, count(*) AS d,
         sum(-0.5 * (ln(2 * pi() * (a.s * a.s + b.s * b.s)) + (a.mu - b.mu) * (a.mu - b.mu) / (a.s * a.s + b.s * b.s))) AS nmp
  FROM g a JOIN g b USING (i) GROUP BY ALL)"""


def _mol(value: str) -> str:
    return _with(
        _v(),
        RANKED,
        LONG,
        MOL1,
        PAIR,
        select=f"""SELECT target, template_id, mol_id, round(sign(z) * ln(1 + abs(z)), 6) + 0.0 AS score, truth
FROM (SELECT *, {value} AS z FROM p)""",
    )


_COV = "0.5 * (logdet - d * ln(2) - 0.5 * (lda + ldb))"

_NMP = _with(
    _v(),
    RANKED,
    LONG,
    MOL1,
    PAIR,
    "own AS (SELECT template_id AS mol_id, nmp AS o FROM p WHERE template_id = mol_id)",
    """q AS (SELECT p.*, a.o AS oa, b.o AS ob, greatest(a.o, b.o, p.nmp) AS top FROM p
  JOIN own a ON a.mol_id = p.template_id JOIN own b ON b.mol_id = p.mol_id)""",
    "w AS (SELECT *, exp(oa - top) + exp(ob - top) - 2 * exp(nmp - top) AS inside FROM q)",
    select="""SELECT target, template_id, mol_id,
  round(CASE WHEN abs(inside) < 1e-12 THEN 0 ELSE ln(1 + exp(0.5 * (top + ln(inside)))) END, 6) AS score, truth FROM w""",
)

_FEATURES = (
    *BASE,
    RANKED,
    _kfold(3, _HASH11),
    """sc AS (SELECT f.target, 1.0::DOUBLE AS portion, p.param, f.fold, f.mol_id, f.active AS truth, r.features[p.param] AS score
  FROM f JOIN r ON r.mol_id = f.mol_id AND r.conf_rank = 1, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS param) p)""",
    *_report("sc", "target, portion, param, fold", "target, portion, param, fold"),
    """summ AS (SELECT target, portion, param, count(auc) AS folds, avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc,
  avg(auc_rank) AS mean_auc_rank, avg(ef_5) AS mean_ef_5, stddev_pop(ef_5) AS std_ef_5 FROM rep GROUP BY ALL)""",
)


_SCAN = (
    *BASE,
    RANKED,
    """c AS (SELECT mol_id, conf_rank, energy, list_sum(list_transform(features,
  lambda x: CASE WHEN abs(x) < 0.01 THEN 0.0::DOUBLE ELSE x END)) AS fs, count(*) OVER (PARTITION BY mol_id) AS nc FROM r)""",
)

# Usable files of the stand-in; the totals are those of all files or of these.
_USABLE = "u AS (SELECT mol_id FROM v GROUP BY mol_id HAVING count(*) > 1)"
_ALL_KEYS = KEYS.replace("k AS", "k0 AS", 1)
_FILE_KEYS = "k AS (SELECT k0.* FROM k0 JOIN u USING (mol_id))"


def _file_sample(totals: str) -> str:
    return _with(
        _v(), T, LIB, _ALL_KEYS, _USABLE, _FILE_KEYS, TOTALS.replace("FROM k ", f"FROM {totals} "),
        *_draw("d", (0.3, 0.8, 10.0), 1.0, 1.0, "SEQUENTIAL", 0),
        select=f"SELECT target, portion, {NAME} AS mol_id, active FROM d",
    )


# One full Gaussian per target: elimination turns (covariance | unit) into (unit | inverse), and the
# pivots give the determinant.
_GMM1_FULL = (
    "WITH RECURSIVE "
    + ",\n".join(
        (
            _v(),
            RANKED,
            T,
            LONG,
            "mu AS (SELECT label AS target, i, avg(x) AS mu FROM long GROUP BY ALL)",
            """cv AS (SELECT a.label AS target, a.i, b.i AS j, avg((a.x - ma.mu) * (b.x - mb.mu)) + CASE WHEN a.i = b.i THEN 1e-6 ELSE 0 END AS c
  FROM long a JOIN long b ON a.mol_id = b.mol_id AND a.conf_id = b.conf_id
  JOIN mu ma ON ma.target = a.label AND ma.i = a.i JOIN mu mb ON mb.target = a.label AND mb.i = b.i GROUP BY a.label, a.i, b.i)""",
            "ha AS (SELECT target, i, list(c ORDER BY j) AS half FROM cv GROUP BY target, i)",
            """ro AS (SELECT target, i, list_concat(half,
    list_transform(range(18), lambda z: CASE WHEN z = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS line FROM ha)""",
            """el AS (SELECT target, 1 AS p, list(line ORDER BY i) AS m, 0.0::DOUBLE AS logdet FROM ro GROUP BY target
  UNION ALL SELECT target, p + 1, list_transform(m, lambda r, n: CASE WHEN n = p
      THEN list_transform(r, lambda y: y / m[p][p])
      ELSE list_transform(r, lambda y, j: y - r[p] * m[p][j] / m[p][p]) END), logdet + ln(m[p][p]) FROM el WHERE p <= 18)""",
            "mv AS (SELECT target, list(mu ORDER BY i) AS mv FROM mu GROUP BY target)",
            """dens AS (SELECT target, mol_id, label, -0.5 * (18 * ln(2 * pi()) + logdet + list_sum(list_transform(range(1, 19), lambda y:
    (features[y] - mv[y]) * list_sum(list_transform(range(1, 19), lambda z: m[y][18 + z] * (features[z] - mv[z])))))) AS ll
  FROM el JOIN mv USING (target), v WHERE p = 19)""",
        )
    )
    + """
SELECT target, 1 AS param, mol_id, round(avg(ll), 6) AS score, any_value(label = target) AS truth
FROM dens GROUP BY target, mol_id"""
)


def oracle_sql() -> dict[str, str]:
    rounded = "round({0}, 6) AS {0}"
    out = {
        "conformer_rank": _with(
            _v(), RANKED, T,
            select="""SELECT target, mol_id, conf_id, label = target AS active, energy, CAST(conf_rank AS INTEGER) AS conf_rank FROM r, t""",
        ),
        "lec_conformers": _with(
            _v(), RANKED, T,
            select="SELECT target, mol_id, conf_id, label = target AS active, energy FROM r, t WHERE conf_rank = 1",
        ),
        "feature_projection": "\nUNION ALL\n".join(
            f"""SELECT target, '{dtype}' AS dtype, CAST(max(len(fe)) AS BIGINT) AS width, count(*) AS conformers,
  round(sum(list_sum(fe)), 6) AS total
FROM (SELECT list_transform(embedding[1:{w}], lambda x: CAST(x AS DOUBLE)) AS fe FROM embeddings),
     (SELECT CAST(unnest(range(10)) AS BIGINT) AS target) GROUP BY target"""
            for dtype, w in (("usr", 12), ("esh", 15), ("es5", 18))
        ),
        "target_label_counts": _with(
            *BASE,
            select="SELECT target, count_if(active) AS num_actives, count_if(NOT active) AS num_decoys FROM k GROUP BY target",
        ),
        "numbering_gaps": _with(
            _v(), LIB,
            "l AS (SELECT label AS target, max(run) AS last FROM lib GROUP BY label)",
            """n AS (SELECT label AS target, true AS active, run AS mol_no FROM lib UNION ALL
  SELECT l.target, false, l.last + 1 + lib.run FROM lib JOIN l ON lib.label = (l.target + 1) % 10)""",
            """rg AS (SELECT target, true AS active, 0 AS lo, max(mol_no) AS hi FROM n WHERE active GROUP BY target UNION ALL
  SELECT l.target, false, l.last + 1, max(mol_no) FROM n JOIN l USING (target) WHERE NOT active GROUP BY l.target, l.last)""",
            select="""SELECT target, active, mol_no FROM (SELECT target, active, unnest(range(lo, hi + 1)) AS mol_no FROM rg)
EXCEPT SELECT target, active, mol_no FROM n""",
        ),
        "numbering_gaps_types": _with(
            _v(), LIB,
            "l AS (SELECT label AS target, max(run) AS last FROM lib GROUP BY label)",
            """n AS (SELECT * FROM (SELECT label AS target, true AS active, run AS mol_no FROM lib UNION ALL
  SELECT l.target, false, l.last + 1 + lib.run FROM lib JOIN l ON lib.label = (l.target + 1) % 10),
  (SELECT unnest(['usr', 'esh', 'es5']) AS dtype) WHERE dtype <> 'usr' OR mol_no % 7 <> 3)""",
            "la AS (SELECT target, dtype, max(mol_no) AS last FROM n WHERE active GROUP BY ALL)",
            """rg AS (SELECT target, dtype, true AS active, 0 AS lo, last AS hi FROM la UNION ALL
  SELECT n.target, n.dtype, false, la.last + 1, max(n.mol_no) FROM n JOIN la USING (target, dtype) WHERE NOT n.active GROUP BY n.target, n.dtype, la.last)""",
            select="""SELECT target, dtype, active, mol_no FROM (SELECT target, dtype, active, unnest(range(lo, hi + 1)) AS mol_no FROM rg)
EXCEPT SELECT target, dtype, active, mol_no FROM n""",
        ),
        "label_counts_types": _with(
            *BASE,
            select="""SELECT target, dtype, count_if(active) AS num_actives, count_if(NOT active) AS num_decoys
FROM k, (SELECT unnest(['all', 'usr', 'esh', 'es5']) AS dtype) GROUP BY target, dtype""",
        ),
        "sample_sequential_files": _file_sample("k"),
        "sample_with_rejects": _file_sample("k0"),
        "mixture_status": _with(
            _v(), T,
            """c AS (SELECT mol_id, CAST(greatest(mol_id % 4, 1) * 4 AS INTEGER) AS k, CAST(count(*) AS INTEGER) AS conformers
  FROM v GROUP BY mol_id)""",
            select="SELECT target, mol_id, k, conformers, CASE WHEN conformers < k THEN 'short' ELSE 'ok' END AS status FROM c, t",
        ),
        "gmm1_full_score": _GMM1_FULL,
        "resume_targets": _with(
            *BASE,
            select="SELECT target FROM k GROUP BY target HAVING count_if(active) < 13",
        ),
        "descriptor_scan": _with(
            *_SCAN,
            select="""SELECT target, count(*) AS files, count_if(nc = 1) AS rejected, count_if(active) AS actives,
  CAST(sum(nc) FILTER (nc > 1) AS BIGINT) AS conformers, CAST(sum(mol_id % 4) FILTER (nc > 1) AS BIGINT) AS rotatable,
  round(sum(energy) FILTER (nc > 1), 6) AS lowest_energy, round(sum(fs) FILTER (nc > 1), 6) AS lowest_features
FROM k JOIN c USING (mol_id) WHERE conf_rank = 1 GROUP BY target""",
        ),
        "rejected_files": _with(
            *_SCAN,
            select=f"""SELECT target, concat('/home/', target, '/', {NAME}, '.es5') AS path, active, 'no conformers' AS reason
FROM k JOIN c USING (mol_id) WHERE nc = 1""",
        ),
        "screen_all": _with(*SCREEN, select="SELECT * FROM s"),
        "screen_lec": _with(
            _v(), RANKED, _scores("WHERE a.conf_rank = 1"), select="SELECT * FROM s"
        ),
        "screen_fraction": _with(
            *BASE, TOTALS, RANKED, _scores("WHERE a.conf_rank = 1"),
            *_draw("d", PORTIONS[1:], 1.0, -1, "SEQUENTIAL", 0),
            select="""SELECT s.target, a.portion, s.template_id, s.mol_id, s.score, s.truth
FROM s JOIN d a ON a.target = s.target AND a.mol_id = s.template_id AND a.active
JOIN d b ON b.target = s.target AND b.mol_id = s.mol_id AND b.portion = a.portion""",
        ),
        "screen_fraction_report": _with(
            *BASE, TOTALS, RANKED, _scores("WHERE a.conf_rank = 1"),
            *_draw("d", PORTIONS[1:], 1.0, -1, "SEQUENTIAL", 0),
            """fs AS (SELECT s.target, a.portion, s.template_id, s.mol_id, s.score, s.truth
  FROM s JOIN d a ON a.target = s.target AND a.mol_id = s.template_id AND a.active
  JOIN d b ON b.target = s.target AND b.mol_id = s.mol_id AND b.portion = a.portion)""",
            *_report("fs", "target, portion", "target, portion, template_id"),
            select="SELECT target, portion, round(auc, 6) AS auc, round(auc_rank, 6) AS auc_rank FROM rep",
        ),
        "screening_descriptors": _with(
            _v(), RANKED,
            *[_scores("WHERE a.conf_rank = 1", w, f"s{w}") for w in (12, 15, 18)],
            "s AS (SELECT 'usr' AS dtype, * FROM s12 UNION ALL SELECT 'esh', * FROM s15 UNION ALL SELECT 'es5', * FROM s18)",
            *_report("s", "target, dtype", "target, dtype, template_id"),
            select="SELECT target, dtype, " + ", ".join(rounded.format(c) for c in ("auc", "auc_rank", "ef_1", "ef_5")) + " FROM rep",
        ),
        "screen_topk": _with(
            *SCREEN,
            select="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, template_id ORDER BY score DESC, mol_id) AS position FROM s)
WHERE position <= 10""",
        ),
        "screening_report": _with(
            *SCREEN, *_report("s", "target", "target, template_id"),
            select="SELECT target, " + ", ".join(rounded.format(c) for c in ("auc", "auc_rank", "ef_1", "ef_5")) + " FROM rep",
        ),
        "auc_sim": _with(*SCREEN, _auc("s", "target", "a"), select="SELECT target, round(auc, 6) AS auc FROM a"),
        "auc_rank": _with(
            *SCREEN, _ranks("s", "target, template_id"), _auc("ranked", "target", "a", "rank_score"),
            select="SELECT target, round(auc, 6) AS auc_rank FROM a",
        ),
        "average_rank": _with(
            *SCREEN, _ranks("s", "target, template_id"),
            select="SELECT target, template_id, score, count(*) AS n, any_value(rank_score) AS avg_rank FROM ranked GROUP BY target, template_id, score",
        ),
        "roc_points": _with(
            *SCREEN,
            """h AS (SELECT target, score, count_if(truth) AS p, count_if(NOT truth) AS n FROM s GROUP BY ALL)""",
            """w AS (SELECT target, score, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY target) AS pt,
  sum(n) OVER (PARTITION BY target) AS nt FROM h WINDOW d AS (PARTITION BY target ORDER BY score DESC))""",
            select="""SELECT target, round(fp::DOUBLE / nt::DOUBLE, 9) AS fpr, round(tp::DOUBLE / pt::DOUBLE, 9) AS tpr, score AS threshold FROM w
UNION ALL SELECT DISTINCT target, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM w""",
        ),
        "enrichment": _with(
            *SCREEN, _ef("s", "target, template_id"),
            select="SELECT target, template_id, threshold, top_n, round(ef, 6) AS ef FROM efs",
        ),
        "auc_lineitem": _with(
            "s AS (SELECT l_suppkey, l_extendedprice AS score, l_returnflag = 'R' AS truth FROM lineitem)",
            _auc("s", "l_suppkey", "a"),
            select="SELECT l_suppkey, round(auc, 6) AS auc FROM a",
        ),
        "ef_events": _with(
            "s AS (SELECT 'events' AS source, event_id, value AS score, event_type = 'purchase' AS truth FROM events)",
            _ef("s", "source", "event_id"),
            select="SELECT source, threshold, top_n, round(ef, 6) AS ef FROM efs",
        ),
        "report_documents": _with(
            """s AS (SELECT lang, doc_id, CAST(n_chars // 100 AS DOUBLE) AS score, quality = 1 AS truth
  FROM documents JOIN labels USING (doc_id))""",
            *_report("s", "lang", "lang", "doc_id"),
            select="SELECT lang, " + ", ".join(rounded.format(c) for c in ("auc", "auc_rank", "ef_1", "ef_5")) + " FROM rep",
        ),
        "sample_sequential": _with(
            *BASE, TOTALS, *_draw("d", (0.3, 0.8, 10.0), 1.0, 1.0, "SEQUENTIAL", 0), select="SELECT * FROM d"
        ),
        "sample_random": _with(
            *BASE, TOTALS, *_draw("d", (0.3, 0.8, 10.0), 1.0, -1, "RANDOM", 7), select="SELECT * FROM d"
        ),
        "sample_lumped": _with(
            *BASE, TOTALS, RANKED, *_draw("d", (0.3,), 1.0, -1, "RANDOM", 7),
            select="SELECT d.*, conf_id, CAST(conf_rank AS INTEGER) AS conf_rank, energy FROM d JOIN r USING (mol_id)",
        ),
        "sample_actives": _with(
            *BASE, TOTALS, *_draw("d", (0.5,), 1.0, 0, "RANDOM", 7), select="SELECT * FROM d"
        ),
        "take_portion": _with(
            *BASE,
            """a AS (SELECT target, mol_id, active FROM (SELECT *, row_number() OVER (PARTITION BY target
  ORDER BY md5(concat('3:', CAST(mol_id AS VARCHAR)))) AS rn, count(*) OVER (PARTITION BY target) AS n FROM k)
  WHERE rn <= floor(n * 0.2::DOUBLE))""",
            """b AS (SELECT target, mol_id, active FROM (SELECT *, row_number() OVER (PARTITION BY target
  ORDER BY md5(concat('4:', CAST(mol_id AS VARCHAR)))) AS rn FROM k ANTI JOIN a USING (target, mol_id)) WHERE rn <= 30)""",
            select="SELECT *, 1 AS part FROM a UNION ALL SELECT *, 2 FROM b",
        ),
        "holdout": _with(*_sets((1.0,)), select="SELECT * FROM sets"),
        "portion_sweep": _with(
            *_sets(PORTIONS),
            select="SELECT target, portion, part, count_if(active) AS actives, count_if(NOT active) AS decoys FROM sets GROUP BY ALL",
        ),
        "kfold": _with(*BASE, _kfold(5, _HASH11), select="SELECT * FROM f"),
        "kfold_sequential": _with(
            *BASE, _kfold(3, f"concat(CASE WHEN active THEN '0' ELSE '1' END, {NAME})"), select="SELECT * FROM f"
        ),
        "fold_train_counts": _with(
            *BASE, _kfold(5, _HASH11),
            select="""SELECT a.target, a.fold AS val_fold, count(*) AS train, count_if(b.active) AS train_actives
FROM (SELECT DISTINCT target, fold FROM f) a JOIN f b ON a.target = b.target AND a.fold <> b.fold GROUP BY ALL""",
        ),
        "gmm1_diag_score": _gmm1(""),
        "gmm1_lec_score": _gmm1("WHERE conf_rank = 1"),
        "gmm_moments": _with(
            *_trained("[1, 10, 50, 100, 1000]"), RANKED, LONG,
            """m AS (SELECT label AS target, i, avg(x) AS mean, var_pop(x) + 1e-6 AS variance FROM long GROUP BY label, i)""",
            select="""SELECT target, param, CAST(i AS INTEGER) AS i, round(mean, 6) AS mean, round(variance, 6) AS variance
FROM m JOIN trained USING (target) WHERE n > param""",
        ),
        "gmm_fold_moments": _with(
            *BASE, _kfold(3, _HASH11), RANKED, LONG,
            """x AS (SELECT f.target, f.fold, i, x FROM f JOIN long ON f.mol_id = long.mol_id WHERE f.active)""",
            """m AS (SELECT x.target, h.fold, x.i, avg(x.x) AS mean, var_pop(x.x) + 1e-6 AS variance, count(*) AS n
  FROM x, (SELECT CAST(unnest(range(3)) AS INTEGER) AS fold) h WHERE x.fold <> h.fold GROUP BY ALL)""",
            select="""SELECT target, CAST(param AS INTEGER) AS param, fold, CAST(i AS INTEGER) AS i, round(mean, 6) AS mean,
  round(variance, 6) AS variance FROM m, (SELECT unnest([1, 10]) AS param) WHERE n > param""",
        ),
        "gmm_rescored": _rescored("[1, 10, 50, 100, 1000]", "n > param"),
        "iforest_facts": _with(
            *_trained("[500, 100, 10]"),
            select="""SELECT target, param, CAST(param AS BIGINT) AS trees, CAST(least(n, 256) AS INTEGER) AS sample,
  CAST(param * least(n, 256) AS BIGINT) AS leaf_rows, CAST(0 AS BIGINT) AS broken FROM trained""",
        ),
        "iforest_rescored": _rescored("[10]"),
        "mlp_rescored": _rescored("[100]"),
        "ocsvm_rescored": _rescored("[50]"),
        "mol_nmp": _NMP,
        "mol_expected_likelihood": _mol("-0.5 * (d * ln(2 * pi()) + logdet + quad)"),
        "mol_bhattacharyya": _mol("-0.25 * quad - 0.5 * (logdet - d * ln(2)) + 0.25 * (lda + ldb)"),
        "mol_bhattacharyya2": _mol(f"ln(0.25 * quad + exp({_COV}))"),
        "mol_bhattacharyya2_distance": _mol(f"0.25 * quad + {_COV}"),
        "xval_summary": _with(
            *_FEATURES,
            select="SELECT target, portion, param, folds, "
            + ", ".join(rounded.format(c) for c in ("mean_auc", "std_auc", "mean_auc_rank", "mean_ef_5", "std_ef_5"))
            + ", CASE WHEN folds > 0 THEN 'ok' ELSE 'skipped' END AS status FROM summ",
        ),
        "resumed_run": _with(
            *BASE, select="SELECT target, CAST(2 AS BIGINT) AS results, CAST(2 AS BIGINT) AS models, true AS together FROM k GROUP BY target"
        ),
        "best_param": _with(
            *_FEATURES,
            select="""SELECT target, portion, param AS best_param FROM (SELECT *, row_number() OVER (
  PARTITION BY target, portion ORDER BY mean_auc DESC, param) AS rn FROM summ) WHERE rn = 1""",
        ),
    }
    for name, direction in (("mean_ef", "DESC"), ("mean_ef_dist", "ASC")):
        out[name] = _with(
            *SCREEN, _ef("s", "target, template_id", direction=direction),
            select="SELECT target, threshold, round(avg(ef), 6) AS mean_ef FROM efs GROUP BY target, threshold",
        )
    return out
