"""The composition parsers restated in SQL, for the correctness checks only."""

from cermetry.functions import constants as K
from cermetry.plans import bridge as B

PHASES = B.in_list(K.CERAMIC_PHASES)
METALS = B.in_list(K.BINDER_METALS)
LEFT = r"^(\d*\.?\d*)\s*(" + "|".join(sorted(K.CERAMIC_PHASES, key=lambda p: (-len(p), p))) + ")"
RIGHT = r"^(\d*\.?\d*)\s*(.*)$"
SYM = r"([A-Z][a-z]?)\s*([0-9]*\.?[0-9]*)"

# cleaned text s, its tokens t, and per format: binder text, binder wt%, phase
PARSE_STEPS = f"""
cleaned AS (SELECT exp_id, trim(regexp_replace(translate(raw_composition, '–—，,;', '--   '), '\\s+', ' ', 'g')) AS s FROM experiments),
toks AS (SELECT exp_id, s, string_split(s, ' ') AS t FROM cleaned),
nf AS (SELECT *, list_filter(range(2, len(t) + 1), lambda i: abs(TRY_CAST(t[1] AS DOUBLE) + TRY_CAST(t[i] AS DOUBLE) - 100) <= 5e-1)[1] AS cut FROM toks),
cand AS (
  SELECT exp_id, 1 AS prio, 'number_first' AS format, array_to_string(t[cut + 1:], ' ') AS btext, TRY_CAST(t[cut] AS DOUBLE) AS wt,
         coalesce(list_filter(t[2:cut - 1], lambda k: k IN {PHASES})[1], t[2:cut - 1][1], 'WC') AS phase, t[2:cut - 1][2] AS secondary
  FROM nf WHERE len(t) >= 3 AND cut IS NOT NULL
  UNION ALL
  SELECT exp_id, 2, 'dash', regexp_extract(trim(p[2]), '{RIGHT}', 2),
         coalesce(TRY_CAST(nullif(regexp_extract(trim(p[2]), '{RIGHT}', 1), '') AS DOUBLE),
                  100 - TRY_CAST(nullif(regexp_extract(trim(p[1]), '{LEFT}', 1), '') AS DOUBLE)),
         regexp_extract(trim(p[1]), '{LEFT}', 2), NULL
  FROM (SELECT exp_id, string_split(s, '-') AS p FROM cleaned)
  WHERE len(p) = 2 AND regexp_extract(trim(p[1]), '{LEFT}', 2) <> ''
    AND (regexp_extract(trim(p[2]), '{RIGHT}', 1) <> '' OR regexp_extract(trim(p[1]), '{LEFT}', 1) <> '')
  UNION ALL
  SELECT exp_id, 3, 'space', btext, 100 - csum, phase, NULL FROM (
    SELECT exp_id,
      string_agg(CASE WHEN k IN {METALS} THEN concat(k, v) END, '' ORDER BY i) AS btext,
      sum(CASE WHEN k IN {PHASES} THEN CAST(v AS DOUBLE) END) AS csum,
      arg_max(CASE WHEN k IN {PHASES} THEN k END, CASE WHEN k IN {PHASES} THEN CAST(v AS DOUBLE) END) AS phase
    FROM (SELECT exp_id, t, i, t[i] AS k, t[i + 1] AS v FROM (SELECT exp_id, t, unnest(range(1, len(t))) AS i FROM toks WHERE len(t) >= 3))
    WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL AND TRY_CAST(k AS DOUBLE) IS NULL GROUP BY exp_id)
  WHERE btext IS NOT NULL AND csum IS NOT NULL
  UNION ALL
  SELECT exp_id, 4, 'prefix', array_to_string(t[4:], ' '), TRY_CAST(t[3] AS DOUBLE), t[2], NULL
  FROM toks WHERE starts_with(s, 'b ') AND len(t) >= 4 AND t[2] IN {PHASES} AND TRY_CAST(t[3] AS DOUBLE) IS NOT NULL
  UNION ALL
  SELECT exp_id, 5, 'placeholder', array_to_string(list_filter(t, lambda k: k IN {METALS}), ''), NULL, list_filter(t, lambda k: k IN {PHASES})[-1], NULL
  FROM toks WHERE list_contains(t, 'x') AND len(list_filter(t, lambda k: k IN {PHASES})) > 0 AND len(list_filter(t, lambda k: k IN {METALS})) > 0
  UNION ALL
  SELECT exp_id, 6, 'pure_alloy', s, 100, NULL, NULL FROM cleaned
  WHERE regexp_matches(s, '^([A-Z][a-z]?\\s*[0-9]*\\.?[0-9]*\\s*)+$')),
cand_raw AS (
  SELECT exp_id, prio, unnest(regexp_extract_all(btext, '{SYM}', 1)) AS el, unnest(regexp_extract_all(btext, '{SYM}', 2)) AS a FROM cand),
cand_amt AS (
  SELECT exp_id, prio, el, sum(CASE WHEN a = '' THEN 1e0 ELSE CAST(a AS DOUBLE) END) AS amt FROM cand_raw GROUP BY ALL),
cand_all AS (SELECT exp_id, prio, sum(amt) AS total, sum(CASE WHEN el IN {METALS} THEN amt END) AS metal FROM cand_amt GROUP BY ALL),
chosen AS (
  SELECT * FROM (
    SELECT c.*, row_number() OVER (PARTITION BY c.exp_id ORDER BY c.prio) AS rn
    FROM cand c JOIN cand_all a USING (exp_id, prio)
    WHERE a.metal > 0 AND (c.prio < 6 OR a.metal > 9e-1 * a.total))
  WHERE rn = 1),
binder AS (
  SELECT exp_id, el, m / sum(m) OVER (PARTITION BY exp_id) AS c FROM (
    SELECT a.exp_id, a.el, CASE WHEN c.prio = 3 THEN a.amt / e.mass ELSE a.amt END AS m
    FROM cand_amt a JOIN chosen c USING (exp_id, prio) LEFT JOIN elements e ON e.symbol = a.el
    WHERE a.el IN {METALS})
  WHERE m IS NOT NULL)"""


def parsed(*extra):
    """WITH items up to ``chosen`` (one row per parsed experiment) and ``binder``
    (its shares)."""
    views = ["experiments", *extra]
    return B.sql(*views) + ",\n" + B.ELEMENTS_SQL + "," + PARSE_STEPS


def formula_text(source="binder", key="exp_id", one="1", digits=2):
    """Sorted ``El<share>`` text per key."""
    scale = 10 ** digits
    cents = f"CAST(round_even(c * {scale}, 0) AS BIGINT)"
    frac = f"rtrim(lpad(CAST({cents} % {scale} AS VARCHAR), {digits}, '0'), '0')"
    short = f"concat(CAST({cents} // {scale} AS VARCHAR), CASE WHEN {frac} = '' THEN '' ELSE concat('.', {frac}) END)"
    return (
        f"SELECT {key}, string_agg(concat(el, CASE WHEN ({short}) = '1' THEN '{one}' ELSE {short} END), '' ORDER BY el) AS formula "
        f"FROM {source} GROUP BY {key}"
    )
