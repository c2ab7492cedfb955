"""DuckDB SQL fragments for the independent oracle.

These are not used by any Spark job; they express the same operator
semantics in plain SQL so ``oracle_sql()`` can check the Spark results.
DuckDB has no gestalt/difflib ratio: the gestalt results are checked against
a literal label table over the labels that are bound, the edit-distance
variant against DuckDB's own edit distance.
"""

from __future__ import annotations

# Fixed values, written out here and not taken from the code under test.
CANONICAL = [
    "Mustard Oil",
    "Sunflower Seed Oil",
    "Groundnut Oil",
    "Soybean Oil",
    "Rice Bran Oil",
    "Olive Oil",
    "Coconut Oil",
    "Multi-Source Edible Oil",
    "Palm Oil",
    "Cotton Seed Oil",
    "Sesame Oil",
    "Refined Vegetable Oil",
]
OVERRIDES = {
    "refinedvegetbleoil": "Refined Vegetable Oil",
    "refinedvegtoil": "Refined Vegetable Oil",
    "refinedvegetoil": "Refined Vegetable Oil",
    "palmmoil": "Palm Oil",
    "groundnutsoil": "Groundnut Oil",
    "groundnutsoils": "Groundnut Oil",
}
FAMILIES = {
    "sunflower": ["Sunflower Seed Oil", "Sunflower Oil"],
    "soy": ["Soybean Oil"],
    "mustard": ["Mustard Oil"],
    "groundnut": ["Groundnut Oil"],
    "rice": ["Rice Bran Oil"],
    "palm": ["Palm Oil"],
    "coconut": ["Coconut Oil"],
    "sesame": ["Sesame Oil"],
    "cotton": ["Cotton Seed Oil"],
    "olive": ["Olive Oil"],
    "blended": ["Refined Vegetable Oil", "Multi-Source Edible Oil"],
}
TOKENS = ["blq", "nd", "loq", "<loq", "not detected", "<"]
CUTOFF = 0.80
LIMITS = {
    "lead": 5, "copper": 5, "arsenic": 5, "tin": 5, "cadmium": 5, "mercury": 5,
    "aflatoxin_b1": 1, "total_aflatoxins": 5, "saponification_value": 180, "iodine_value": 120,
    "unsaponifiable_matter": 130, "acid_value": 3,
}
POSITIVE_FAILS = ["polybromide_test", "argemone", "mineral_oil"]
# Text that Python's float() reads, for the values that are bound.
NUMBER = r"[+-]?([0-9]+(_[0-9]+)*([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i)[+-]?(inf|nan)"
# What the gestalt score makes of each label that is bound: a label table, not
# a second scoring.  Labels without their last word: two are too short to match.
CUT_LABELS = {name[:-4]: name for name in CANONICAL} | {"Olive": "Olive", "Palm": "Palm"}
OVERRIDE_LABELS = {
    "Refined Vegetble Oil": "Refined Vegetable Oil", "refinedvegtoil": "Refined Vegetable Oil",
    "REFINED VEGETOIL": "Refined Vegetable Oil", "Palmm Oil": "Palm Oil", "Groundnuts Oil": "Groundnut Oil",
    "groundnutsoils": "Groundnut Oil", "ghee blend": "Ghee Blend",
}


def _s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def canon_cte() -> str:
    rows = ", ".join(f"({i}, {_s(n)})" for i, n in enumerate(CANONICAL))
    return (f"canon AS (SELECT idx, name, lower(name) AS lo, regexp_replace(lower(name), '\\s+', '', 'g') AS ns "
            f"FROM (VALUES {rows}) t(idx, name))")


def overrides_cte() -> str:
    rows = ", ".join(f"({_s(k)}, {_s(v)})" for k, v in OVERRIDES.items())
    return f"ovr AS (SELECT * FROM (VALUES {rows}) t(k, v))"


def families_cte() -> str:
    rows = []
    seen = set()
    for fam, members in FAMILIES.items():
        for m in members:
            if m not in seen:
                seen.add(m)
                rows.append(f"({_s(m)}, {_s(fam)})")
    return f"fam AS (SELECT * FROM (VALUES {', '.join(rows)}) t(member, family))"


def title_expr(s: str) -> str:
    """Python str.title() in DuckDB."""
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({s}, i - 1, 1), '[A-Za-z]') THEN upper(substr({s}, i, 1)) "
            f"ELSE lower(substr({s}, i, 1)) END), '')")


def _score(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"


def std_map_ctes(prefix: str, raw_values_sql: str) -> str:
    """CTEs ``{prefix}_map(raw, std)`` for the distinct non-null raw values
    produced by ``raw_values_sql`` (one column named raw)."""
    p = prefix
    cut = CUTOFF
    return f"""
{p}_raw AS (SELECT DISTINCT raw FROM ({raw_values_sql}) WHERE raw IS NOT NULL),
{p}_cl AS (SELECT raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS cleaned FROM {p}_raw),
{p}_k AS (SELECT raw, cleaned, lower(cleaned) AS lo, regexp_replace(lower(cleaned), '\\s+', '', 'g') AS ns FROM {p}_cl),
{p}_m1 AS (SELECT raw, name FROM (
   SELECT c.raw, k.name, {_score('c.ns', 'k.ns')} AS s,
          row_number() OVER (PARTITION BY c.raw ORDER BY {_score('c.ns', 'k.ns')} DESC, k.ns DESC, k.idx) AS rn
   FROM {p}_k c, canon k) WHERE rn = 1 AND s >= {cut}),
{p}_m2 AS (SELECT raw, name FROM (
   SELECT c.raw, k.name, {_score('c.lo', 'k.lo')} AS s,
          row_number() OVER (PARTITION BY c.raw ORDER BY {_score('c.lo', 'k.lo')} DESC, k.lo DESC, k.idx) AS rn
   FROM {p}_k c, canon k) WHERE rn = 1 AND s >= {cut}),
{p}_map AS (SELECT c.raw, coalesce(o.v, m1.name, m2.name, {title_expr('c.cleaned')}) AS std
   FROM {p}_k c LEFT JOIN ovr o ON o.k = c.ns LEFT JOIN {p}_m1 m1 ON m1.raw = c.raw
   LEFT JOIN {p}_m2 m2 ON m2.raw = c.raw)"""


def family_expr(x: str) -> str:
    return f"coalesce((SELECT family FROM fam WHERE member = {x}), lower(trim(CAST({x} AS VARCHAR))))"


def nondetect_expr(x: str) -> str:
    terms = " OR ".join(f"contains(lower(trim({x})), {_s(t)})" for t in TOKENS)
    return f"({terms})"


def number_expr(x: str) -> str:
    return (f"(CASE WHEN regexp_full_match(trim({x}), {_s(NUMBER)}) "
            f"THEN TRY_CAST(replace(trim({x}), '_', '') AS DOUBLE) END)")


def limit_msg(x: str, limit: int) -> str:
    num = number_expr(x)
    return (f"CASE WHEN {x} IS NULL OR {nondetect_expr(x)} THEN NULL "
            f"WHEN {num} IS NULL THEN printf('%s = ''%s'' (unreadable value)', {_s(x)}, trim({x})) "
            f"WHEN {num} > {limit} AND NOT isnan({num}) "
            f"THEN printf('%s = %.4f (max allowed: {limit})', {_s(x)}, {num}) END")


def positive_msg(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) = 'positive' THEN {_s(x)} || ' = ' || trim({x}) || ' (expected Negative)' END"


def rule_rows_cte() -> str:
    """``rr``: testing as one row per non-null value, rule by rule."""
    parts = [f"SELECT sample_code, {_s(x)} AS rule, {x} AS value, {number_expr(x)} AS number, {limit_msg(x, n)} AS message "
             f"FROM testing WHERE {x} IS NOT NULL" for x, n in LIMITS.items()]
    parts += [f"SELECT sample_code, {_s(x)}, {x}, CAST(NULL AS DOUBLE), {positive_msg(x)} "
              f"FROM testing WHERE {x} IS NOT NULL" for x in POSITIVE_FAILS]
    return "rr AS (" + "\nUNION ALL ".join(parts) + ")"


def gestalt_map_ctes(prefix: str, raw_values_sql: str) -> str:
    """``{prefix}_map(raw, std)`` looked up in the label table; a label that
    the table lacks gets NULL and fails the comparison."""
    fixed = ", ".join(f"({_s(k)}, {_s(v)})" for k, v in (CUT_LABELS | OVERRIDE_LABELS).items())
    return f"""
{prefix}_labels AS (SELECT DISTINCT raw, std FROM (
   SELECT unnest([name, upper(name), lo, ns, '  ' || name || ' ', name[1] || name[3:]]) AS raw, name AS std FROM canon
   UNION ALL SELECT * FROM (VALUES {fixed}) t(raw, std))),
{prefix}_map AS (SELECT DISTINCT r.raw, l.std FROM ({raw_values_sql}) r LEFT JOIN {prefix}_labels l ON l.raw = r.raw
   WHERE r.raw IS NOT NULL)"""


def testing_eval_ctes() -> str:
    """``t_eval``: testing + Pass_Fail, Failure_Reason, Sampler_Oil_Std,
    Lab_Oil_Std, Mismatch_Type."""
    msgs = ", ".join([limit_msg(x, n) for x, n in LIMITS.items()] + [positive_msg(x) for x in POSITIVE_FAILS])
    return f"""
{canon_cte()},
{overrides_cte()},
{families_cte()},
{gestalt_map_ctes('t', 'SELECT oil_sampler AS raw FROM testing UNION SELECT oil_lab AS raw FROM testing')},
t_rules AS (SELECT *, concat_ws(' | ', {msgs}) AS Failure_Reason FROM testing),
t_std AS (SELECT r.*, CASE WHEN Failure_Reason <> '' THEN 'FAIL' ELSE 'PASS' END AS Pass_Fail,
                 ms.std AS Sampler_Oil_Std, ml.std AS Lab_Oil_Std
          FROM t_rules r LEFT JOIN t_map ms ON ms.raw = r.oil_sampler LEFT JOIN t_map ml ON ml.raw = r.oil_lab),
t_eval AS (SELECT *, CASE WHEN Sampler_Oil_Std IS NULL OR Lab_Oil_Std IS NULL THEN 'Cannot Determine'
                          WHEN Sampler_Oil_Std = Lab_Oil_Std THEN 'Match'
                          WHEN {family_expr('Sampler_Oil_Std')} = {family_expr('Lab_Oil_Std')} THEN 'Minor Mismatch'
                          ELSE 'Major Mismatch' END AS Mismatch_Type
           FROM t_std)"""


def collection_std_ctes(method: str = "gestalt") -> str:
    """``c_std``: collection + Oil_Type_Standardized."""
    ctes = gestalt_map_ctes if method == "gestalt" else std_map_ctes
    return f"""
{ctes('c', 'SELECT oil_raw AS raw FROM collection')},
c_std AS (SELECT c.*, m.std AS Oil_Type_Standardized FROM collection c LEFT JOIN c_map m ON m.raw = c.oil_raw)"""


def master_ctes() -> str:
    """``master``: inner join of c_std and t_eval on sample_code (needs
    canon/ovr/fam from ``testing_eval_ctes``)."""
    return f"""{testing_eval_ctes()},
{collection_std_ctes()},
master AS (SELECT c.*, t.* EXCLUDE (sample_code) FROM c_std c JOIN t_eval t ON c.sample_code = t.sample_code)"""
