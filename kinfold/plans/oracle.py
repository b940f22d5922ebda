"""The registered queries as plain SQL for an independent engine (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence

from kinfold.plans.catalog import CONVERGED, DECIMALS, LOIO_REG, N_BOOT, SEED
from kinfold.plans.views import EVENT_CLASSES, LINE_CLASSES, MIXED_CLASSES, ROOT, VECTOR_CLASSES

R = DECIMALS
RATIOS = ("sensitivity", "specificity", "ppv", "npv", "f1", "accuracy_ovr")
METRICS = (*RATIOS, "auc")
COMPARED = ("sensitivity", "specificity", "ppv", "npv", "f1", "auc")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def values(classes: Sequence[str], name: str = "cls") -> str:
    rows = ", ".join(f"({k}, '{c}')" for k, c in enumerate(classes))
    return f"{name}(k, label) AS (VALUES {rows})"


LINE = """raw AS (
  SELECT concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS image_path, l_returnflag AS species,
         l_returnflag || '-' || l_suppkey AS isolate_id,
         CASE WHEN l_linestatus = 'F' THEN 'colony' ELSE 'microscopic' END AS modality,
         CASE WHEN l_returnflag = 'A' THEN l_quantity / 100 + 0.3 ELSE l_quantity / 100 END AS a,
         CASE WHEN l_returnflag = 'N' THEN l_discount * 5 + 0.3 ELSE l_discount * 5 END AS n,
         CASE WHEN l_returnflag = 'R' THEN l_tax * 6 + 0.3 ELSE l_tax * 6 END AS r
  FROM lineitem),
preds AS (
  SELECT image_path, species, isolate_id, modality,
         [a / (a + n + r), n / (a + n + r), r / (a + n + r)] AS s FROM raw)"""

#: Missing scores are NaN here, as in a score array.
MIXED = LINE.replace("preds AS", "line_preds AS") + """,
preds AS (
  SELECT image_path, species, split_part(image_path, '/', 3) AS isolate_id, modality,
         [s[3], s[1], CASE WHEN split_part(image_path, '/', 4)::INTEGER % 7 <> 3 THEN s[2] ELSE 'NaN'::DOUBLE END] AS s FROM line_preds)"""

VECTORS = """logits AS (
  SELECT vec_id, label, [""" + ", ".join(" + ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(k, 64, 10)) for k in range(10)) + """] AS l FROM embeddings),
shifted AS (
  SELECT vec_id, label, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM logits),
preds AS (
  SELECT 'vec/' || vec_id AS image_path, 'class_' || label AS species,
         'class_' || label || '-' || (vec_id % 5) AS isolate_id, 'microscopic' AS modality,
         list_transform(e, lambda x: x / list_sum(e)) AS s FROM shifted)"""

EVENTS = f"""manifest_raw AS (
  SELECT 'img/' || event_id || '.png' AS image_path, event_type AS species,
         CASE WHEN user_id % 10 = 0 THEN '' ELSE ' ' || event_type || '-' || (user_id % 5) || ' ' END AS isolate_id,
         CASE WHEN event_id % 3 = 0 THEN 'colony' ELSE 'microscopic' END AS modality,
         CASE WHEN event_id % 3 <> 0 THEN '' WHEN event_id % 2 = 0 THEN 'obverse' ELSE 'reverse' END AS view,
         CASE event_id % 4 WHEN 0 THEN 'smartphone' WHEN 1 THEN 'microscope_camera' ELSE '' END AS device,
         CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN (event_id % 14) || '.0'
              ELSE (event_id % 14)::VARCHAR END AS "day",
         CASE WHEN user_id % 10 = 0 THEN 'openfungi' ELSE 'cmu' END AS source, event_id
  FROM events),
filled AS (
  SELECT '{ROOT}/' || image_path AS image_path, species, trim(isolate_id) AS isolate_id, modality,
         CASE WHEN view = '' THEN 'na' ELSE view END AS view,
         CASE WHEN device = '' THEN 'unknown' ELSE device END AS device, "day", source, event_id
  FROM manifest_raw),
ev AS (
  SELECT image_path, species, CASE WHEN isolate_id = '' THEN 'img:' || image_path ELSE isolate_id END AS isolate_id,
         modality, view, device, CAST(TRY_CAST("day" AS DOUBLE) AS BIGINT) AS "day", source, event_id
  FROM filled)"""

SCORED = """scored AS (
  SELECT p.*, c.k AS true_k, list_position(s, list_max(s)) - 1 AS pred_k FROM preds p JOIN cls c ON c.label = p.species)"""


def grouped(size: int, by: str = "") -> str:
    means = ", ".join(f"coalesce(round(avg(s[{k + 1}]) FILTER (WHERE NOT isnan(s[{k + 1}])), 12), 'NaN'::DOUBLE)" for k in range(size))
    return f"""grp AS (
  SELECT {by} isolate_id, arg_min(species, image_path) AS species, arg_min(true_k, image_path) AS true_k, count(*) AS n_items, [{means}] AS s
  FROM scored GROUP BY {by} isolate_id),
levelled AS (
  SELECT {by} 'image_level' AS level, isolate_id, true_k, pred_k, s FROM scored
  UNION ALL
  SELECT {by} 'isolate_level', isolate_id, true_k, list_position(s, list_max(s)) - 1, s FROM grp)"""


def ratio(num: str, den: str) -> str:
    return f"(({num})::DOUBLE / nullif(({den})::DOUBLE, 0))"


RATIO_SQL = f"""{ratio('tp', 'tp + fn')} AS sensitivity, {ratio('tn', 'tn + fp')} AS specificity,
         CASE WHEN tp + fp > 0 THEN {ratio('tp', 'tp + fp')} WHEN support > 0 THEN 0.0::DOUBLE END AS ppv,
         {ratio('tn', 'tn + fn')} AS npv, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
         {ratio('tp + tn', 'total')} AS accuracy_ovr"""


def class_counts(keys: str, source: str, grid: str, weight: str = "1") -> str:
    """``counts`` and ``ratios`` CTEs for key columns ``keys`` (with a trailing comma), from rows or weighted rows."""
    names = [k.strip() for k in keys.split(",") if k.strip()]
    on = " AND ".join([f"g.{n} = c.{n}" for n in names]) or "true"
    cols = "".join(f"g.{n}, " for n in names)
    part = f"PARTITION BY {', '.join(names)}" if names else ""
    return f"""cells AS (
  SELECT {keys} true_k, pred_k, sum({weight})::BIGINT AS n FROM {source} GROUP BY {keys} true_k, pred_k),
counts AS (
  SELECT {cols} g.k,
         coalesce(sum(n) FILTER (WHERE true_k = g.k AND pred_k = g.k), 0)::BIGINT AS tp,
         coalesce(sum(n) FILTER (WHERE true_k = g.k AND pred_k <> g.k), 0)::BIGINT AS fn,
         coalesce(sum(n) FILTER (WHERE true_k <> g.k AND pred_k = g.k), 0)::BIGINT AS fp,
         coalesce(sum(n), 0)::BIGINT AS total
  FROM ({grid}) g LEFT JOIN cells c ON {on} GROUP BY {cols} g.k),
ratios AS (
  SELECT *, {RATIO_SQL} FROM (
    SELECT {keys} k, tp, fn, fp, total - tp - fn - fp AS tn, tp + fn AS support, total FROM counts))"""


def auc(keys: str, source: str, size: int, weight: str = "1", decimals: int | None = None) -> str:
    names = [k.strip() for k in keys.split(",") if k.strip()]
    score = "s[k + 1]" if decimals is None else f"round(s[k + 1], {decimals})"
    part = ", ".join([*names, "k"])
    return f"""long AS (
  SELECT {keys} k, {score} AS score, true_k = k AS pos, {weight} AS w
  FROM {source}, (SELECT unnest(range({size}))::INTEGER AS k)),
ties AS (
  SELECT {keys} k, score, coalesce(sum(w) FILTER (WHERE pos), 0)::BIGINT AS p,
         coalesce(sum(w) FILTER (WHERE NOT pos), 0)::BIGINT AS q FROM long GROUP BY {keys} k, score),
ranked AS (
  SELECT *, coalesce(sum(q) OVER (PARTITION BY {part} ORDER BY score
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM ties),
areas AS (
  SELECT {keys} k, sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives,
         CASE WHEN NOT bool_or(isnan(score) AND p + q > 0)
              THEN sum(p::DOUBLE * (below::DOUBLE + q / 2.0)) / nullif(sum(p)::DOUBLE * sum(q)::DOUBLE, 0) END AS auc
  FROM ranked GROUP BY {keys} k)"""


def levels_grid(size: int) -> str:
    return f"""SELECT level, k FROM (VALUES ('image_level'), ('isolate_level')) l(level),
  (SELECT unnest(range({size}))::INTEGER AS k)"""


def rounded(names: Sequence[str]) -> str:
    return ", ".join(f"round({n}, {R}) AS {n}" for n in names)


def two_level(preds: str, classes: Sequence[str]) -> str:
    size = len(classes)
    return with_(
        values(classes), preds, SCORED, grouped(size), class_counts("level,", "levelled", levels_grid(size)),
        auc("level,", "levelled", size),
        """full_table AS (SELECT r.*, a.auc, c.label FROM ratios r LEFT JOIN areas a ON a.level = r.level AND a.k = r.k
  JOIN cls c ON c.k = r.k)""",
    )


COUNTS = "tp, fn, fp, tn, support, total"
MACRO_AVG = ", ".join(f"avg({m}) FILTER (WHERE support > 0) AS macro_{m}" for m in METRICS)
MACRO_NAMES = [f"macro_{m}" for m in METRICS]


def macro_sql(keys: str) -> str:
    return f"""macro AS (
  SELECT {keys} max(total) AS n, {ratio('sum(tp)', 'max(total)')} AS accuracy, {MACRO_AVG} FROM full_table GROUP BY {keys.rstrip(', ')})"""


def draws_sql(n_boot: int, groups: str) -> str:
    """``mult(b, isolate_id, m)`` from a ``groups`` relation with isolate_id and species."""
    return f"""strat AS (
  SELECT isolate_id, CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM {groups} GROUP BY species)) >= 2
                          THEN species ELSE '*' END AS stratum FROM {groups}),
slots AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{SEED}:' || isolate_id), isolate_id) - 1 AS ordinal,
         count(*) OVER (PARTITION BY stratum) AS size FROM strat),
picks AS (
  SELECT b, stratum, ('0x' || substr(md5('{SEED}:' || b || ':' || stratum || ':' || ordinal), 1, 15))::BIGINT % size AS pick
  FROM slots, (SELECT unnest(range({n_boot})) AS b)),
picked AS (SELECT b, stratum, pick, count(*) AS m FROM picks GROUP BY ALL),
mult AS (
  SELECT p.b, s.isolate_id, p.m FROM picked p JOIN slots s ON s.stratum = p.stratum AND s.ordinal = p.pick)"""


def bootstrap(preds: str, classes: Sequence[str], n_boot: int, with_auc: bool) -> str:
    size = len(classes)
    grid = f"SELECT level, b, k FROM ({levels_grid(size)}), (SELECT unnest(range({n_boot})) AS b)"
    parts = [
        values(classes), preds, SCORED, grouped(size), draws_sql(n_boot, "grp"),
        # Rows that agree in everything a metric reads are counted once before they meet the replicates.
        """base AS (SELECT level, isolate_id, true_k, pred_k, count(*) AS c FROM levelled GROUP BY ALL),
repeated AS (SELECT l.level, m.b, l.true_k, l.pred_k, m.m * l.c AS w FROM base l JOIN mult m ON m.isolate_id = l.isolate_id)""",
        class_counts("level, b,", "repeated", grid, "w"),
    ]
    if with_auc:
        parts += [
            "repeated_rows AS (SELECT l.level, m.b, l.true_k, l.s, m.m FROM levelled l JOIN mult m ON m.isolate_id = l.isolate_id)",
            auc("level, b,", "repeated_rows", size, "m"),
            "full_table AS (SELECT r.*, a.auc FROM ratios r LEFT JOIN areas a ON a.level = r.level AND a.b = r.b AND a.k = r.k)",
        ]
    else:
        parts.append("full_table AS (SELECT *, NULL::DOUBLE AS auc FROM ratios)")
    parts.append(macro_sql("level, b,"))
    return with_(*parts)


def interval_rows(names: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT level, '{n}' AS metric, round(quantile_cont({n}, 0.025), {R}) AS low,"
        f" round(quantile_cont({n}, 0.975), {R}) AS high FROM macro GROUP BY level"
        for n in names
    )


PLANES = """px AS (
  SELECT vec_id, (unnest(range(64)))::BIGINT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
lim AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY vec_id),
levels AS (
  SELECT px.vec_id, i, CASE WHEN hi > lo THEN floor((v::FLOAT - lo::FLOAT) * (255.0::DOUBLE / (hi - lo))::FLOAT) ELSE 0 END::INTEGER AS v
  FROM px JOIN lim ON lim.vec_id = px.vec_id)"""


def stretch(image: str, tone: str, percent: int, size: int) -> str:
    cut = size * percent // 100
    return f"""ordered AS (
  SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) - 1 AS pos FROM {tone}),
cuts AS (
  SELECT vec_id, max(v) FILTER (WHERE pos = {cut})::DOUBLE AS lo, max(v) FILTER (WHERE pos = {size - 1 - cut})::DOUBLE AS hi
  FROM ordered GROUP BY vec_id)
SELECT m.vec_id, m.i, CASE WHEN hi > lo THEN least(greatest(floor(m.v * (255.0::DOUBLE / (hi - lo)) - lo * (255.0::DOUBLE / (hi - lo))), 0), 255)
                           ELSE m.v END::INTEGER AS value
FROM {image} m JOIN cuts c ON c.vec_id = m.vec_id"""


CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in EVENT_CLASSES) + "]"
KFOLD = f"""grp AS (SELECT isolate_id, min(species) AS species, count(*) AS n_items FROM ev GROUP BY isolate_id),
dealt AS (
  SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || species), species, md5('{SEED}:' || isolate_id), isolate_id) - 1 AS pos
  FROM grp)"""


def describe(folds: str) -> str:
    """``folds(fold, isolate_id, species, n_items)`` and ``names(fold)`` to the description of every fold."""
    return f"""SELECT n.fold,
       ((SELECT count(*) FROM ev) - coalesce(sum(n_items), 0))::BIGINT AS train_items,
       coalesce(sum(n_items), 0)::BIGINT AS val_items,
       ((SELECT count(*) FROM grp) - count(f.isolate_id))::BIGINT AS train_groups,
       count(f.isolate_id)::BIGINT AS val_groups,
       array_to_string(list_filter({CLASS_LIST},
         lambda c: NOT coalesce(list_contains(list(DISTINCT species), c), false)), ',') AS val_classes_without_groups
FROM names n LEFT JOIN {folds} f ON f.fold = n.fold GROUP BY n.fold"""


ITEMS = """items AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, 'vec/' || vec_id AS image_path, 'class_' || label AS species, label::INTEGER AS y, vec_id,
         'class_' || label || '-' || (vec_id % 5) AS isolate_id, list_prepend(1.0::DOUBLE, embedding::DOUBLE[]) AS x FROM embeddings),
grp AS (SELECT isolate_id, min(species) AS species, count(*) AS n_items FROM items GROUP BY isolate_id),
dealt AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || species), species, md5('42:' || isolate_id), isolate_id) - 1 AS pos FROM grp)"""


def trained(mode: str) -> str:
    """``trn(f, i, x, y, w)`` from the training rows ``pairs(f, i)`` of every head."""
    rows = "FROM pairs p JOIN items t ON t.i = p.i"
    weight = {
        "none": "1.0::DOUBLE",
        "sampler": """1.0::DOUBLE / ((SELECT count(DISTINCT isolate_id) FROM pairs q JOIN items u ON u.i = q.i WHERE q.f = p.f AND u.y = t.y)
                                     * (SELECT n_items FROM grp WHERE grp.isolate_id = t.isolate_id))""",
        "loss": "count(*) OVER (PARTITION BY p.f)::DOUBLE / (10 * count(*) OVER (PARTITION BY p.f, t.y))",
    }[mode]
    return f"trn AS (SELECT p.f, t.i, t.x, t.y, {weight} AS w {rows})"


def fit(steps: int, reg: float) -> str:
    """``path(t, f, k, here, before)``: accelerated gradient steps of every head over ``trn``; the curvature is that of all ``items``."""
    vector = "list_transform(range(1, 66), lambda j: {})"
    probe = vector.format("here[j] + m * (here[j] - before[j])")
    return f"""norm AS (SELECT f, i, x, y, w / sum(w) OVER (PARTITION BY f) AS w FROM trn),
columns AS (SELECT f, j, list(x[j] ORDER BY i) AS v FROM norm, (SELECT unnest(range(1, 66)) AS j) GROUP BY f, j),
lim AS (SELECT l, (sqrt(l / {reg}) - 1) / (sqrt(l / {reg}) + 1) AS top FROM (SELECT max(list_inner_product(x, x)) / 2 + {reg} AS l FROM items)),
path AS (
  SELECT 0 AS t, f, k, list_transform(range(65), lambda j: 0.0::DOUBLE) AS here, list_transform(range(65), lambda j: 0.0::DOUBLE) AS before
  FROM (SELECT DISTINCT f FROM trn), (SELECT unnest(range(10))::INTEGER AS k)
  UNION ALL
  SELECT * FROM (
    WITH probe AS (
      SELECT t, f, k, here, l, {probe} AS v
      FROM (SELECT *, least(top, greatest(0, t - 1)::DOUBLE / (t + 2)) AS m FROM path, lim WHERE t < {steps})),
    z AS (SELECT n.f, n.i, n.y, n.w, k, list_inner_product(n.x, v) AS z FROM probe JOIN norm n ON n.f = probe.f),
    e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY f, i)) AS e FROM z),
    r AS (SELECT f, i, k, w * (e / sum(e) OVER (PARTITION BY f, i) - (y = k)::INTEGER) AS r FROM e),
    lists AS (SELECT f, k, list(r ORDER BY i) AS r FROM r GROUP BY f, k),
    g AS (SELECT s.f, s.k, list(list_inner_product(c.v, s.r) ORDER BY j) AS g FROM lists s JOIN columns c ON c.f = s.f GROUP BY s.f, s.k)
    SELECT t + 1, p.f, p.k, {vector.format(f"p.v[j] - (g.g[j] + {reg} * p.v[j]) / l")}, p.here
    FROM probe p JOIN g ON g.f = p.f AND g.k = p.k)),
heads AS (SELECT f, k, here AS v FROM path WHERE t = {steps})"""


def head_predictions(fold: str, pairing: str) -> str:
    """The prediction table of ``items`` scored by ``heads``, joined by ``pairing``."""
    probs = ", ".join(f"round(max(p) FILTER (WHERE k = {k}), {R}) AS prob_class_{k}" for k in range(10))
    return f""", z AS (SELECT i.*, h.f, h.k, list_inner_product(i.x, h.v) AS z FROM items i JOIN heads h ON {pairing}),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY i)) AS e FROM z),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY i) AS p FROM e)
SELECT image_path, species, isolate_id, MODALITY AS modality, 'na' AS view, 'unknown' AS device, NULL::BIGINT AS "day", 'cmu' AS source,
       {fold} AS fold, 'class_' || arg_max(k, p) AS predicted, {probs}
FROM p GROUP BY i, image_path, species, isolate_id, vec_id, f"""


def draw(seed_word: str, slot: str) -> str:
    return f"('0x' || substr(md5('{SEED}:{seed_word}:' || {slot}), 1, 15))::BIGINT"


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    line_cells = with_(values(LINE_CLASSES), LINE, SCORED)
    grid3 = "SELECT unnest(range(3))::INTEGER AS k"

    for name, preds, classes in (
        ("confusion_matrix", LINE, LINE_CLASSES), ("confusion_matrix_vectors", VECTORS, VECTOR_CLASSES),
    ):
        sql[name] = with_(values(classes), preds, SCORED) + """
SELECT t.label AS true_label, p.label AS pred_label, count(s.true_k)::BIGINT AS n
FROM cls t CROSS JOIN cls p LEFT JOIN scored s ON s.true_k = t.k AND s.pred_k = p.k GROUP BY 1, 2"""
    sql["per_class_metrics"] = with_(values(LINE_CLASSES), LINE, SCORED, class_counts("", "scored", grid3)) + f"""
SELECT label, {COUNTS}, {rounded(RATIOS)} FROM ratios r JOIN cls c ON c.k = r.k"""
    sql["macro_metrics"] = two_level(LINE, LINE_CLASSES) + f", {macro_sql('level,')}\n" + (
        f"SELECT level, n, {rounded(['accuracy', *MACRO_NAMES])} FROM macro")
    sql["classes_without_support"] = with_(LINE, values([*LINE_CLASSES, "X"])) + """
SELECT k::BIGINT AS k, label FROM cls WHERE NOT EXISTS (SELECT 1 FROM preds WHERE species = label)"""
    line_probs = ", ".join(f"round(s[{k + 1}], {R}) AS prob_{c}" for k, c in enumerate(LINE_CLASSES))
    vote = f"""SELECT isolate_id, species, n_items, (SELECT label FROM cls WHERE k = list_position(s, list_max(s)) - 1) AS predicted,
       {line_probs} FROM grp"""
    sql["group_vote"] = with_(values(LINE_CLASSES), LINE, SCORED, grouped(3)) + vote
    sql["combine_modalities"] = sql["group_vote"]
    sql["two_level_report"] = two_level(LINE, LINE_CLASSES) + f"SELECT level, label, {COUNTS}, {rounded(METRICS)} FROM full_table"
    sql["two_level_report_mixed"] = two_level(MIXED, MIXED_CLASSES) + f"SELECT level, label, {COUNTS}, {rounded(METRICS)} FROM full_table"
    sql["two_level_report_vectors"] = two_level(VECTORS, VECTOR_CLASSES) + (
        f"SELECT level, label, {COUNTS}, {rounded(METRICS)} FROM full_table")
    sql["auc_ovr"] = with_(values(LINE_CLASSES), LINE, SCORED, auc("", "scored", 3)) + f"""
SELECT label, round(auc, {R}) AS auc, positives, negatives FROM areas a JOIN cls c ON c.k = a.k"""
    sql["auc_ovr_rounded"] = with_(values(LINE_CLASSES), LINE, SCORED, auc("", "scored", 3, decimals=3)) + f"""
SELECT label, round(auc, {R}) AS auc FROM areas a JOIN cls c ON c.k = a.k"""

    clean = 'SELECT image_path, species, isolate_id, modality, view, device, "day", source FROM ev'
    sql["manifest_clean"] = with_(EVENTS) + clean
    sql["manifest_csv_roundtrip"] = with_(EVENTS) + clean
    sql["quoted_line_breaks"] = """SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest, lang AS "last"
FROM (SELECT doc_id::VARCHAR AS doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t, coalesce(lang, '') AS lang FROM documents)"""
    whole_days = """CASE WHEN regexp_matches("day", '^[0-9]+$') THEN "day"::BIGINT END"""
    sql["manifest_load_into"] = with_(EVENTS) + f"""
SELECT image_path, species, trim(r.isolate_id || '/' || species) AS isolate_id, modality, view, device, {whole_days} AS "day", source
FROM (SELECT f.* EXCLUDE isolate_id, raw.isolate_id FROM filled f JOIN manifest_raw raw ON raw.event_id = f.event_id) r"""
    sql["folder_listing"] = "SELECT (user_id % 40)::BIGINT AS bucket, 1::BIGINT AS n_files FROM events GROUP BY user_id % 40"
    sql["run_config_file"] = """SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS classes, 'kfold' AS split, 5::BIGINT AS n_folds,
       count(*) AS items, 0.2::DOUBLE AS val_fraction FROM events"""
    sql["review_sheet_file"] = "SELECT image_path, true_species, predicted, probability, panel, notes FROM (REVIEW)"
    sql["manifest_relative_paths"] = with_(EVENTS) + f"""
SELECT replace(image_path, '{ROOT}/', '') AS image_path, isolate_id, coalesce("day"::VARCHAR, '') AS "day" FROM ev"""
    first3 = "array_to_string(list(item ORDER BY item)[1:3], ',') AS examples"
    sql["domain_violations"] = with_(EVENTS, """bad AS (
  SELECT 'modality' AS "column", modality AS value, image_path AS item FROM ev WHERE modality <> 'microscopic'
  UNION ALL SELECT 'view', view, image_path FROM ev WHERE view NOT IN ('na', 'obverse')
  UNION ALL SELECT 'device', device, image_path FROM ev WHERE device <> 'unknown'
  UNION ALL SELECT 'source', source, image_path FROM ev WHERE source <> 'cmu')""") + f"""
SELECT 'domain' AS rule, "column", value, count(*) AS n, {first3} FROM bad GROUP BY "column", value"""
    sql["blank_group_violations"] = with_(EVENTS) + f"""
SELECT 'blank_group' AS rule, 'isolate_id' AS "column", count(*) AS n, {first3.replace('item', 'image_path')}
FROM filled WHERE isolate_id = '' AND source = 'openfungi' HAVING count(*) > 0"""
    conflicts = """SELECT source AS isolate_id, count(DISTINCT lang) AS n_labels, min(lang) AS first_label, max(lang) AS last_label
FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1"""
    sql["label_conflicts"] = conflicts
    sql["manifest_violations"] = f"""WITH absent AS (
  SELECT '{ROOT}/doc/' || doc_id AS item FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
blank AS (SELECT '{ROOT}/doc/' || doc_id AS item FROM documents WHERE trim(source) = ''),
conflict AS ({conflicts})
SELECT 'missing_item' AS rule, 'image_path' AS "column", '' AS value, count(*) AS n, {first3} FROM absent HAVING count(*) > 0
UNION ALL SELECT 'blank_group', 'isolate_id', '', count(*), {first3.replace(' AS examples', '')} FROM blank HAVING count(*) > 0
UNION ALL SELECT 'label_conflict', 'species', isolate_id, n_labels, first_label || ',' || last_label FROM conflict"""
    sql["missing_items"] = """SELECT 'doc/' || doc_id AS image_path, lang AS species, source AS isolate_id, 'microscopic' AS modality
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
    sql["day_coercion"] = with_(EVENTS) + 'SELECT "day", count(*) AS n FROM ev GROUP BY "day"'
    sql["select_subset"] = with_(EVENTS) + """
SELECT image_path, isolate_id, device FROM ev WHERE modality = 'microscopic' AND source = 'cmu'"""
    sql["select_while_reading"] = sql["select_subset"]
    sql["class_check"] = with_(EVENTS) + """
SELECT species, count(*) AS n FROM ev WHERE species NOT IN ('click', 'view') GROUP BY species"""
    sql["class_list"] = with_(EVENTS) + """
SELECT row_number() OVER (ORDER BY species) - 1 AS k, species, count(*) AS n FROM ev GROUP BY species"""
    sql["label_encoding"] = with_(EVENTS, values(EVENT_CLASSES)) + """
SELECT image_path, k::INTEGER AS k FROM ev JOIN cls ON label = species"""
    sql["dataset_summary"] = with_(EVENTS) + """
SELECT modality, count(*) AS n_items, count(DISTINCT isolate_id) AS n_groups, count(DISTINCT species) AS n_classes
FROM ev GROUP BY modality"""

    sql["group_table"] = with_(EVENTS) + """
SELECT isolate_id, min(species) AS species, count(*) AS n_items FROM ev GROUP BY isolate_id"""
    sql["kfold_assign"] = with_(EVENTS, KFOLD) + """
SELECT image_path, ev.isolate_id, 'fold' || (pos % 5) AS fold FROM ev JOIN dealt ON dealt.isolate_id = ev.isolate_id"""
    sql["holdout_assign"] = with_(EVENTS, KFOLD) + """
SELECT image_path, 'holdout' AS fold, CASE WHEN pos % 5 = 0 THEN 'val' ELSE 'train' END AS side
FROM ev JOIN dealt ON dealt.isolate_id = ev.isolate_id"""
    sql["loio_folds"] = with_(EVENTS, KFOLD) + "SELECT 'loio_' || isolate_id AS fold, isolate_id, species, n_items FROM grp"
    sql["leakage_check"] = with_(EVENTS) + """
SELECT 'by_row' AS fold, isolate_id FROM ev GROUP BY isolate_id HAVING count(DISTINCT event_id % 4 = 0) > 1"""
    sql["fold_coverage"] = with_(EVENTS) + """
SELECT 'fold' || i AS fold, count(*)::BIGINT AS "rows", count(DISTINCT image_path)::BIGINT AS items,
       (SELECT count(*) FROM ev) AS wanted, count(*) = (SELECT count(*) FROM ev) AS covered
FROM ev, (SELECT unnest(range(5)) AS i) GROUP BY i"""
    sql["describe_folds"] = with_(
        EVENTS, KFOLD, "names AS (SELECT 'fold' || i AS fold FROM (SELECT unnest(range(5)) AS i))",
        "folds AS (SELECT 'fold' || (pos % 5) AS fold, isolate_id, species, n_items FROM dealt)",
    ) + describe("folds")
    sql["describe_loio_folds"] = with_(
        EVENTS, KFOLD, "folds AS (SELECT 'loio_' || isolate_id AS fold, isolate_id, species, n_items FROM grp)",
        "names AS (SELECT fold FROM folds)",
    ) + describe("folds")

    weights = """per_class AS (SELECT species, count(DISTINCT isolate_id) AS g FROM ev GROUP BY species),
per_group AS (SELECT isolate_id, count(*) AS i FROM ev GROUP BY isolate_id),
weighted AS (
  SELECT ev.*, 1.0::DOUBLE / (g * i) AS weight FROM ev JOIN per_class c ON c.species = ev.species
  JOIN per_group p ON p.isolate_id = ev.isolate_id)"""
    loss = f"""loss AS (
  SELECT label AS species, k::INTEGER AS k, coalesce(n, 0)::BIGINT AS n,
         CASE WHEN n > 0 THEN (SELECT count(*) FROM ev)::DOUBLE / ({len(EVENT_CLASSES)} * n)::DOUBLE ELSE 0.0 END::DOUBLE AS weight
  FROM cls LEFT JOIN (SELECT species, count(*) AS n FROM ev GROUP BY species) c ON c.species = cls.label)"""
    sql["balanced_weights"] = with_(EVENTS, weights) + f"SELECT image_path, isolate_id, round(weight, {R}) AS weight FROM weighted"
    sql["class_loss_weights"] = with_(EVENTS, values(EVENT_CLASSES), loss) + f"SELECT species, k, n, round(weight, {R}) AS weight FROM loss"
    sql["imbalance_weights"] = with_(EVENTS, values(EVENT_CLASSES), weights, loss) + f"""
SELECT species, round(sum(weight), {R}) AS weight, 'sampler' AS mode FROM weighted GROUP BY species
UNION ALL SELECT species, round(n * weight, {R}), 'loss' FROM loss WHERE n > 0
UNION ALL SELECT species, count(*)::DOUBLE, 'none' FROM ev GROUP BY species"""
    sql["weighted_resample"] = with_(
        EVENTS,
        """present AS (SELECT list(DISTINCT species ORDER BY species) AS c FROM ev),
grp AS (
  SELECT species, isolate_id, count(*) AS n_items FROM ev GROUP BY species, isolate_id),
granks AS (
  SELECT *, row_number() OVER (PARTITION BY species ORDER BY md5('42:' || isolate_id), isolate_id) - 1 AS g,
         count(*) OVER (PARTITION BY species) AS groups FROM grp),
iranks AS (
  SELECT *, row_number() OVER (PARTITION BY species, isolate_id ORDER BY md5('42:' || image_path), image_path) - 1 AS ordinal FROM ev),
class_sizes AS (SELECT species, count(*) AS groups FROM grp GROUP BY species)""",
        f"""picked_class AS (
  SELECT image_path AS slot, c[({draw('class', 'image_path')} % len(c)) + 1] AS species FROM ev, present),
picked_group AS (
  SELECT slot, p.species, {draw('group', 'slot')} % s.groups AS g FROM picked_class p JOIN class_sizes s ON s.species = p.species),
picked_item AS (
  SELECT r.species, r.isolate_id, {draw('item', 'slot')} % r.n_items AS ordinal
  FROM picked_group p JOIN granks r ON r.species = p.species AND r.g = p.g)""",
    ) + """
SELECT i.image_path, i.isolate_id, count(*) AS copies FROM picked_item p
JOIN iranks i ON i.species = p.species AND i.isolate_id = p.isolate_id AND i.ordinal = p.ordinal
GROUP BY i.image_path, i.isolate_id"""

    recursive = lambda *parts: with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)
    reg = CONVERGED["reg"]
    kfold_items = ITEMS + """,
folds AS (SELECT i, 'fold' || (pos % 5) AS fold FROM items JOIN dealt ON dealt.isolate_id = items.isolate_id)"""
    loio_items = ITEMS + ", folds AS (SELECT i, 'loio_' || isolate_id AS fold FROM items)"
    others = "pairs AS (SELECT n.fold AS f, i FROM folds, (SELECT DISTINCT fold FROM folds) n WHERE folds.fold <> n.fold)"
    everyone = "pairs AS (SELECT 'all' AS f, i FROM items)"
    micro = lambda text: text.replace("MODALITY", "'microscopic'")
    own_fold = micro(head_predictions("f", "h.f = (SELECT fold FROM folds WHERE folds.i = i.i)"))
    sql["oof_predictions"] = recursive(kfold_items, others, trained("sampler"), fit(90, reg)) + own_fold
    sql["loio_predictions"] = recursive(loio_items, others, trained("none"), fit(50, LOIO_REG)) + own_fold
    sql["eval_saved_head"] = recursive(ITEMS, everyone, trained("sampler"), fit(90, reg)) + micro(head_predictions("'eval'", "true"))
    sql["final_fit"] = recursive(ITEMS, everyone, trained("loss"), fit(90, reg)) + f"""
SELECT f AS fold, k::BIGINT AS k, i::INTEGER AS i, round(v[i + 1], {R}) AS weight FROM heads, (SELECT unnest(range(65)) AS i)"""
    modality = "CASE WHEN vec_id % 2 = 0 THEN 'colony' ELSE 'microscopic' END"
    sql["modality_routing"] = recursive(ITEMS, f"pairs AS (SELECT {modality} AS f, i FROM items)", trained("none"), fit(90, reg)) + (
        head_predictions("'eval'", f"h.f = {modality}").replace("MODALITY", modality))
    probe = "list_transform(range(1, 66), lambda j: here[j] + m * (here[j] - before[j]))"
    sql["fit_history"] = recursive(
        ITEMS, "pairs AS (SELECT 'holdout' AS f, i FROM items JOIN dealt ON dealt.isolate_id = items.isolate_id WHERE pos % 5 <> 0)",
        trained("loss"), fit(15, reg),
    ) + f""", points AS (
  SELECT t, f, k, {probe} AS v FROM (SELECT *, CASE WHEN t < 15 THEN least(top, greatest(0, t - 1)::DOUBLE / (t + 2)) ELSE 0 END AS m FROM path, lim)),
z AS (SELECT p.t, p.f, p.k, n.i, n.y, n.w, list_inner_product(n.x, p.v) AS z FROM points p JOIN norm n ON n.f = p.f),
e AS (SELECT *, max(z) OVER (PARTITION BY t, f, i) AS top FROM z),
per_row AS (
  SELECT t, f, i, w, y, ln(sum(exp(z - top))) + max(top) - max(z) FILTER (WHERE k = y) AS loss, list(k ORDER BY z DESC, k)[1] AS best FROM e GROUP BY t, f, i, w, y),
size AS (SELECT t, f, {reg} / 2 * sum(list_inner_product(v, v)) AS ridge FROM points GROUP BY t, f)
SELECT r.f AS fold, r.t::BIGINT AS iteration, round(sum(w * loss) + any_value(ridge), {R}) AS loss, round(avg((best = y)::INTEGER), {R}) AS accuracy
FROM per_row r JOIN size s ON s.t = r.t AND s.f = r.f GROUP BY r.f, r.t"""

    line_groups = "grp AS (SELECT isolate_id, min(species) AS species FROM preds GROUP BY isolate_id)"
    sql["bootstrap_method"] = with_(LINE, line_groups) + """
SELECT CASE WHEN ok THEN species ELSE '*' END AS stratum,
       CASE WHEN ok THEN 'isolates within class' ELSE 'isolates' END AS method, count(*) AS n_groups
FROM grp, (SELECT min(n) >= 2 AS ok FROM (SELECT count(*) AS n FROM grp GROUP BY species)) GROUP BY 1, 2"""
    sql["bootstrap_draws"] = with_(LINE, line_groups, draws_sql(N_BOOT, "grp")) + "SELECT b, isolate_id, m FROM mult"
    sql["bootstrap_ci_accuracy"] = bootstrap(LINE, LINE_CLASSES, N_BOOT, False) + interval_rows(["accuracy"])
    names = ["accuracy", *MACRO_NAMES]
    sql["bootstrap_ci_macro"] = bootstrap(LINE, LINE_CLASSES, N_BOOT, True) + interval_rows(names)
    sql["bootstrap_ci_mixed"] = bootstrap(MIXED, MIXED_CLASSES, N_BOOT, True) + interval_rows(names)
    sql["bootstrap_ci_vectors"] = bootstrap(VECTORS, VECTOR_CLASSES, N_BOOT, True) + interval_rows(names)
    sql["value_with_ci"] = bootstrap(LINE, LINE_CLASSES, N_BOOT, False) + """,
whole AS (SELECT level, avg((true_k = pred_k)::INTEGER) AS accuracy FROM levelled GROUP BY level)
SELECT w.level, format('{:.3f}', w.accuracy) || ' [' || format('{:.2f}', quantile_cont(m.accuracy, 0.025))
       || '-' || format('{:.2f}', quantile_cont(m.accuracy, 0.975)) || ']' AS accuracy
FROM whole w JOIN macro m ON m.level = w.level GROUP BY w.level, w.accuracy"""

    sql["report_document_ci"] = "SELECT level, metric, low, high, 'isolates within class' AS method, " + (
        f"{N_BOOT}::INTEGER AS replicates FROM ({bootstrap(LINE, LINE_CLASSES, N_BOOT, True)}{interval_rows(names)})"
    )
    texts = ", ".join(
        f"format('{{:.3f}}', w.{m}) || ' [' || format('{{:.2f}}', i.low_{m}) || '-' || format('{{:.2f}}', i.high_{m}) || ']' AS {m}"
        for m in ("accuracy", *[f"macro_{c}" for c in COMPARED])
    )
    bounds = ", ".join(
        f"quantile_cont({m}, 0.025) AS low_{m}, quantile_cont({m}, 0.975) AS high_{m}" for m in ("accuracy", *[f"macro_{c}" for c in COMPARED])
    )
    sql["compare_report_ci"] = f"""SELECT 'all' AS run, CASE w.level WHEN 'image_level' THEN 'image' ELSE 'isolate' END AS level, w.n, {texts}
FROM ({two_level(LINE, LINE_CLASSES)}, {macro_sql('level,')} SELECT * FROM macro) w
JOIN ({bootstrap(LINE, LINE_CLASSES, N_BOOT, True)} SELECT level, {bounds} FROM macro GROUP BY level) i ON i.level = w.level"""

    sql["softmax_scores"] = f"""WITH x AS (
  SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
e AS (SELECT vec_id, i, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM x)
SELECT 'vec/' || vec_id AS image_path, i::INTEGER AS k, round(e / sum(e) OVER (PARTITION BY vec_id), {R}) AS score FROM e"""
    sql["argmax_labels"] = with_(values(VECTOR_CLASSES), VECTORS, SCORED) + """
SELECT image_path, label AS predicted FROM scored JOIN cls ON cls.k = scored.pred_k"""
    sql["scores_long"] = with_(values(LINE_CLASSES), LINE) + f"SELECT image_path, label, round(s[k + 1], {R}) AS score FROM preds, cls"
    sql["scores_wide"] = with_(VECTORS) + "SELECT image_path, " + ", ".join(
        f"round(s[{k + 1}], {R}) AS prob_{c}" for k, c in enumerate(VECTOR_CLASSES)) + " FROM preds"
    sql["ranked_scores_per_item"] = with_(values(VECTOR_CLASSES), VECTORS) + f"""
SELECT image_path, row_number() OVER (PARTITION BY image_path ORDER BY s[k + 1] DESC, k) AS "rank", label,
       round(s[k + 1], {R}) AS score FROM preds, cls"""
    fixed = """'na' AS view, 'unknown' AS device, NULL::BIGINT AS "day", 'cmu' AS source"""
    sql["prediction_table"] = line_cells + f"""
SELECT image_path, species, isolate_id, modality, {fixed}, 'eval' AS fold, label AS predicted, {line_probs}
FROM scored JOIN cls ON cls.k = scored.pred_k"""
    sql["predictions_as_manifest"] = line_cells + f"""
SELECT '{ROOT}/' || image_path AS image_path, species, isolate_id, {fixed}, label AS predicted
FROM scored JOIN cls ON cls.k = scored.pred_k"""
    sql["combine_modalities_equal"] = with_(values(LINE_CLASSES), LINE, """per AS (
  SELECT isolate_id, modality, min(species) AS species, avg(s[1]) AS a, avg(s[2]) AS n, avg(s[3]) AS r
  FROM preds GROUP BY isolate_id, modality),
grp AS (
  SELECT isolate_id, min(species) AS species, count(*) AS n_items, [round(avg(a), 12), round(avg(n), 12), round(avg(r), 12)] AS s
  FROM per GROUP BY isolate_id)""") + vote.replace("n_items,", "n_items AS n_modalities,")
    sql["union_folds"] = with_(values(LINE_CLASSES), LINE, SCORED, f"""grp AS (
  SELECT isolate_id, min(species) AS species FROM preds GROUP BY isolate_id),
dealt AS (
  SELECT isolate_id, row_number() OVER (ORDER BY md5('{SEED}:' || species), species, md5('{SEED}:' || isolate_id), isolate_id) - 1 AS pos
  FROM grp)""") + """
SELECT 'fold' || (pos % 5) AS fold, label AS predicted, count(*) AS n
FROM scored s JOIN dealt d ON d.isolate_id = s.isolate_id JOIN cls ON cls.k = s.pred_k GROUP BY 1, 2"""

    sql["headline_summary"] = two_level(LINE, LINE_CLASSES) + f", {macro_sql('level,')}\n" + "\nUNION ALL\n".join(
        f"SELECT level, '{n}' AS metric, round({n}, {R}) AS value FROM macro" for n in names)
    sql["report_document"] = two_level(LINE, LINE_CLASSES) + "\nUNION ALL\n".join(
        f"SELECT level, label, '{n}' AS metric, round({n}::DOUBLE, {R}) AS value FROM full_table" for n in ("support", *METRICS))
    compared = COMPARED
    both = with_(
        values(LINE_CLASSES), LINE, SCORED, grouped(3, "modality,"),
        class_counts("modality, level,", "levelled", f"SELECT modality, level, k FROM ({levels_grid(3)}), (VALUES ('colony'), ('microscopic')) m(modality)"),
        auc("modality, level,", "levelled", 3),
        "full_table AS (SELECT r.*, a.auc FROM ratios r LEFT JOIN areas a ON a.modality = r.modality AND a.level = r.level AND a.k = r.k)",
        macro_sql("modality, level,"),
    )
    level = "CASE level WHEN 'image_level' THEN 'image' ELSE 'isolate' END AS level"
    shown = ["accuracy", *[f"macro_{m}" for m in compared]]
    sql["compare_runs"] = both + f"SELECT modality AS run, {level}, n, {rounded(shown)} FROM macro"
    text = ", ".join(f"coalesce(format('{{:.3f}}', {n}), 'nan') AS {n}" for n in shown)
    sql["compare_report_files"] = both + f"SELECT modality AS run, {level}, n, {text} FROM macro"
    first2 = "row_number() OVER (PARTITION BY species ORDER BY image_path) AS rn"
    sql["first_n_per_class"] = with_(LINE) + f"""
SELECT image_path, species FROM (SELECT *, {first2} FROM preds WHERE modality = 'colony') WHERE rn <= 2"""
    sql["review_sheet"] = with_(values(LINE_CLASSES), LINE, SCORED, f"numbered AS (SELECT *, {first2} FROM scored)") + """
SELECT image_path, species AS true_species, label AS predicted, format('{:.4f}', list_max(s))::DOUBLE AS probability,
       format('{:04d}_{}.png', row_number() OVER (ORDER BY image_path) - 1, split_part(image_path, '/', 4)) AS panel,
       '' AS reviewer, '' AS concordant_with_morphology, '' AS highlighted_structure, '' AS artifact_suspected, '' AS notes
FROM numbered n JOIN cls ON cls.k = n.pred_k WHERE rn <= 2"""
    sql["evidence_top_features"] = with_(values(VECTOR_CLASSES), VECTORS, SCORED, f"""feat AS (
  SELECT 'vec/' || vec_id AS image_path, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
head AS (SELECT label AS k, i, round(avg(x), {R}) AS w FROM feat GROUP BY label, i),
support AS (
  SELECT f.image_path, s.pred_k, f.i, greatest(h.w * f.x, 0.0) AS v
  FROM feat f JOIN scored s ON s.image_path = f.image_path JOIN head h ON h.k = s.pred_k AND h.i = f.i),
scaled AS (
  SELECT image_path, pred_k, i, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0.0) AS v
  FROM support WINDOW w AS (PARTITION BY image_path)),
placed AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY v DESC, i) AS rn FROM scaled)""") + f"""
SELECT image_path, label AS predicted, rn AS "rank", i::BIGINT AS feature, round(v, {R}) AS evidence
FROM placed JOIN cls ON cls.k = placed.pred_k WHERE rn <= 5"""

    sql["unit_scale"] = with_(PLANES) + f"""
SELECT px.vec_id, i, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, {R}) AS value FROM px JOIN lim ON lim.vec_id = px.vec_id"""
    sql["minmax_u8"] = with_(PLANES) + "SELECT vec_id, i, v AS value FROM levels"
    sql["autocontrast"] = with_(
        PLANES, "dim AS (SELECT vec_id, i, (100 + floor(v / 8))::INTEGER AS v FROM levels)", stretch("dim", "dim", 5, 64))
    colours = """rgb AS (
  SELECT vec_id, i * 3 + c AS i, CASE c WHEN 0 THEN v WHEN 1 THEN 255 - v ELSE (v + 128) % 256 END AS v FROM levels, (SELECT unnest(range(3)) AS c))"""
    tone = """tone AS (
  SELECT vec_id, i // 3 AS i, (sum(v * CASE i % 3 WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END)::BIGINT + 32768) >> 16 AS v
  FROM rgb GROUP BY vec_id, i // 3)"""
    sql["autocontrast_rgb"] = with_(PLANES, colours, tone, stretch("rgb", "tone", 10, 64))
    sql["center_crop_rgb"] = with_(PLANES, colours) + """
SELECT vec_id, (((i // 24) - 2) * 4 + (i // 3) % 8 - 2) * 3 + i % 3 AS i, v AS value
FROM rgb WHERE i // 24 BETWEEN 2 AND 5 AND (i // 3) % 8 BETWEEN 2 AND 5"""
    sql["prepare_images"] = with_(
        PLANES,
        """rgb AS (
  SELECT vec_id, i * 3 + c AS i, CASE c WHEN 0 THEN 100 + v // 4 WHEN 1 THEN 90 + v // 3 ELSE v END AS v FROM levels, (SELECT unnest(range(3)) AS c))""",
        tone, f"stretched AS (WITH {stretch('rgb', 'tone', 5, 64)})",
        """tri AS (
  SELECT o, j, greatest(1.0::DOUBLE - abs((j + 0.5::DOUBLE - (o + 0.5::DOUBLE) * (4 / 3.0::DOUBLE)) / (4 / 3.0::DOUBLE)), 0) AS w, n
  FROM (VALUES (3, 4), (12, 16)) t(n, m), (SELECT unnest(range(12)) AS o), (SELECT unnest(range(16)) AS j) WHERE o < n AND j < m),
axis AS (SELECT n, o, j, w / sum(w) OVER (PARTITION BY n, o) AS w FROM tri)""",
    ) + f"""
SELECT vec_id, (y.o * 3 + x.o - 4) * 3 + p.i % 3 AS i,
       round((floor(round(sum(p.value * y.w * x.w), 9) + 0.5) / 255.0::DOUBLE - any_value(m)) / any_value(s), {R}) AS value
FROM stretched p JOIN axis y ON y.n = 3 AND y.j = p.i // 48 JOIN axis x ON x.n = 12 AND x.j = (p.i // 3) % 16
JOIN (VALUES (0, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456, 0.224), (2, 0.406, 0.225)) t(c, m, s) ON c = p.i % 3
WHERE x.o BETWEEN 4 AND 6 GROUP BY vec_id, y.o, x.o, p.i % 3"""
    sql["center_crop"] = with_(PLANES) + f"""
SELECT vec_id, (i // 8 - 2) * 4 + (i % 8 - 2) AS i, round(v, {R}) AS value FROM px WHERE i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5"""
    sql["channel_normalise"] = with_(PLANES) + f"""
SELECT vec_id, i * 3 + c AS i, round((v / 255.0::DOUBLE - m) / s, {R}) AS value
FROM levels, (VALUES (0, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456, 0.224), (2, 0.406, 0.225)) t(c, m, s)"""
    sql["alpha_over_white"] = with_(PLANES, "alpha AS (SELECT vec_id, i // 4 AS p, v / 255.0::DOUBLE AS a FROM levels WHERE i % 4 = 3)") + """
SELECT l.vec_id, p * 3 + l.i % 4 AS i, floor(l.v * a + 255.0::DOUBLE * (1.0::DOUBLE - a) + 0.5)::INTEGER AS value
FROM levels l JOIN alpha ON alpha.vec_id = l.vec_id AND p = l.i // 4 WHERE l.i % 4 < 3"""
    sql["grey_to_rgb"] = with_(PLANES) + "SELECT vec_id, i * 3 + c AS i, v AS value FROM levels, (SELECT unnest(range(3)) AS c)"
    sql["resize_shorter_side"] = with_(PLANES, """tri AS (
  SELECT o, j, greatest(1.0::DOUBLE - abs(j + 0.5::DOUBLE - (o + 0.5::DOUBLE) * 2) / 2, 0) AS w
  FROM (SELECT unnest(range(4)) AS o), (SELECT unnest(range(8)) AS j)),
axis AS (SELECT o, j, w / sum(w) OVER (PARTITION BY o) AS w FROM tri)""") + f"""
SELECT vec_id, y.o * 4 + x.o AS i, round(sum(v * y.w * x.w), {R}) AS value
FROM px JOIN axis y ON y.j = i // 8 JOIN axis x ON x.j = i % 8 GROUP BY vec_id, y.o, x.o"""
    sql["review_sheet_file"] = sql["review_sheet_file"].replace("REVIEW", sql["review_sheet"])
    return sql
