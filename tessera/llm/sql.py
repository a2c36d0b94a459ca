"""DuckDB SQL for operators whose results SQL can express."""

from __future__ import annotations

from tessera.llm import outliers as o

WORDS = "coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])"

SUBSTRINGS = f"""
WITH split AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 19], ' ')) AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM split WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS n FROM windows) WHERE n > 1
), covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
gone AS (SELECT doc_id, list(i) AS g FROM covered GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(g, i)), ' ') END) AS kept_sha256
FROM split s LEFT JOIN gone ON s.doc_id = gone.doc_id
"""

_BASE = f"""
split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM split WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, key) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS i FROM twice) GROUP BY doc_id
), base AS (
  SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered ON s.doc_id = covered.doc_id
)"""


def outlier_sql() -> str:
    """The whole of ``outliers.judge``: the same steps, one common table expression each."""
    ps = range(o.P)
    xs = ", ".join(f"x{i}" for i in ps)

    def chol(name: str, source: str) -> str:
        out = []
        for i, j in sorted(o.PAIRS):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append(f"sqrt(greatest(c{i}{i}{inner}, 1e-9)) AS l{i}{i}" if i == j else f"(c{i}{j}{inner}) / l{j}{j} AS l{i}{j}")
        return f"{name} AS (SELECT grp, st, {', '.join(f'm{i}' for i in ps)}, {', '.join(out)} FROM {source})"

    def distance(name: str, rows: str, estimate: str, key: str = "grp", kept: str = xs + ", st") -> str:
        z = ", ".join(f"(x{i} - m{i}{''.join(f' - l{i}{j} * z{j}' for j in range(i))}) / l{i}{i} AS z{i}" for i in ps)
        total = " + ".join(f"z{i} * z{i}" for i in ps)
        return f"{name} AS (SELECT r.{key} AS grp, {kept}, {z}, {total} AS d2, floor(ln(d2 + 1e-9) * {o.GRID}) AS cell FROM {rows} r JOIN {estimate} e ON r.{key} = e.grp)"

    def quantile(name: str, rows: str, share: float) -> str:
        return (
            f"{name} AS (SELECT grp, st, min(cell) AS cut FROM (SELECT grp, st, cell, sum(n) OVER (PARTITION BY grp, st ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY grp, st) AS al "
            f"FROM (SELECT grp, st, cell, count(*) AS n FROM {rows} GROUP BY grp, st, cell)) WHERE upto >= al * {share}e0 GROUP BY grp, st)"
        )

    def moments(name: str, source: str) -> str:
        return f"{name} AS (SELECT grp, st, " + ", ".join([f"m{i}" for i in ps] + [f"s{i}{j} - m{i} * m{j} + {o.FLOORS[i] ** 2 if i == j else 0.0!r}::DOUBLE AS c{i}{j}" for i, j in o.PAIRS]) + f" FROM {source})"

    averages = ", ".join([f"avg(x{i}) AS m{i}" for i in ps] + [f"avg(x{i} * x{j}) AS s{i}{j}" for i, j in o.PAIRS])
    columns = "grp, st, " + ", ".join([f"m{i}" for i in ps] + [f"c{i}{j}" for i, j in o.PAIRS])
    off_diagonal = ", ".join(f"0e0 AS c{i}{j}" for i, j in o.PAIRS if i != j)

    n = "greatest(n_words, 1)::DOUBLE"
    raw = [f"ln({n})", f"word_chars / {n}", f"ln(0.01e0 + n_symbols / {n})", f"n_dup_lines / greatest(n_dup_lines + {n} / 20, 1e0)", f"sqrt(n_repeat_words / {n})"]
    parts = [
        _BASE,
        "counted AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, "
        + ", ".join(f"round(({x}) * {o.SCALE}) / {o.SCALE} AS x{i}" for i, x in enumerate(raw))
        + ", to_json({'l': lang, 's': source})::VARCHAR AS g2, to_json({'l': lang})::VARCHAR AS g1 FROM base)",
        "usable AS (SELECT * FROM counted WHERE NOT base_failed)",
        "named AS (SELECT g2, g1, count(*) AS n2 FROM usable GROUP BY g2, g1)",
        f"choice AS (SELECT g2, CASE WHEN n2 >= {o.LEAST} THEN g2 WHEN sum(n2) OVER (PARTITION BY g1) >= {o.LEAST} THEN g1 ELSE '{{}}' END AS use FROM named)",
        f"leveled AS (SELECT g2 AS grp, {xs} FROM usable UNION ALL SELECT g1, {xs} FROM usable UNION ALL SELECT '{{}}', {xs} FROM usable)",
        f"picked AS (SELECT grp, {xs} FROM leveled WHERE grp IN (SELECT use FROM choice))",
        "stacked AS (" + " UNION ALL ".join(f"SELECT grp, {i} AS k, floor(x{i} * {o.GRID}) AS cell FROM picked" for i in ps) + ")",
        "placed AS (SELECT grp, k, cell, sum(n) OVER (PARTITION BY grp, k ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY grp, k) AS al "
        "FROM (SELECT grp, k, cell, count(*) AS n FROM stacked GROUP BY grp, k, cell))",
        "quartiles AS (SELECT grp, k, min(cell) FILTER (WHERE upto >= al * 0.25e0) AS q1, min(cell) FILTER (WHERE upto >= al * 0.5e0) AS q2, min(cell) FILTER (WHERE upto >= al * 0.75e0) AS q3 FROM placed GROUP BY grp, k)",
        "medians AS (SELECT grp, 0 AS st, "
        + ", ".join(f"max(CASE WHEN k = {i} THEN (q2 + 0.5e0) / {o.GRID} END) AS m{i}, max(CASE WHEN k = {i} THEN pow((q3 - q1) / {o.GRID * 1.349!r}, 2e0) + {o.FLOORS[i] ** 2!r}::DOUBLE END) AS c{i}{i}" for i in ps)
        + f", {off_diagonal} FROM quartiles GROUP BY grp)",
        "floors AS (SELECT grp, 1 AS st, " + ", ".join(f"m{i}" for i in ps) + ", " + ", ".join(f"{o.FLOORS[i] ** 2!r}::DOUBLE AS c{i}{i}" for i in ps) + f", {off_diagonal} FROM medians)",
        f"sums AS (SELECT grp, 2 AS st, {averages} FROM picked GROUP BY grp)",
        moments("whole", "sums"),
        f"start AS (SELECT {columns} FROM medians UNION ALL SELECT {columns} FROM floors UNION ALL SELECT {columns} FROM whole)",
        chol("e0", "start"),
    ]
    for k in range(o.STEPS):
        parts += [
            distance(f"d{k}", "picked", f"e{k}"),
            quantile(f"q{k}", f"d{k}", o.SUBSET),
            f"s{k} AS (SELECT d.grp, d.st, {averages} FROM d{k} d JOIN q{k} q ON d.grp = q.grp AND d.st = q.st WHERE cell <= cut GROUP BY d.grp, d.st)",
            moments(f"c{k}", f"s{k}"),
            chol(f"e{k + 1}", f"c{k}"),
        ]
    parts += [
        f"best AS (SELECT * FROM e{o.STEPS} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {' * '.join(f'(l{i}{i} * l{i}{i})' for i in ps)}, st) = 1)",
        distance("dn", "picked", "best"),
        quantile("middle", "dn", 0.5),
        f"final AS (SELECT e.*, greatest(exp((cut + 0.5e0) / {o.GRID}) / {o.CHI2_MEDIAN}e0, 1e0) AS scale FROM best e JOIN middle m ON e.grp = m.grp)",
        "chosen AS (SELECT counted.*, use FROM counted JOIN choice ON counted.g2 = choice.g2 WHERE NOT base_failed)",
        distance("dist", "chosen", "final", "use", "doc_id, scale"),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed, round(d.d2 / d.scale, 4) AS distance, "
        f"coalesce(d.d2 / d.scale <= {o.CUTOFF!r}, FALSE) AS kept FROM counted b LEFT JOIN dist d ON b.doc_id = d.doc_id"
    )


# -- conversation repair: a walk over the turns, with the cheapest edits for each role written last ----

_least = lambda *ways: f"list_min([{', '.join(ways)}])"
_edit = lambda state, cost, letter: f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}'}} END"
_keep = lambda state, initial: f"CASE WHEN initial = '{initial}' AND NOT due AND {state} IS NOT NULL THEN {{'cost': {state}.cost + charge, 'audit': {state}.audit || 'K'}} END"
_role = lambda state: f"CASE WHEN NOT due AND {state} IS NOT NULL THEN {{'cost': {state}.cost + 3 + charge, 'audit': {state}.audit || 'R'}} END"
_WRITTEN = _least("u", *(_edit(s, 3, "I") for s in ("none", "sys", "a")))

CONVERSATIONS = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM source, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, substring(role, 1, 1) AS initial,
    rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS solid
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair
  FROM placed
), turns AS (
  SELECT *, fault IN ('blank', 'duplicate') AS due, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS charge FROM judged
), states AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'cost': 0::BIGINT, 'audit': ''}} AS none, NULL::STRUCT(cost BIGINT, audit VARCHAR) AS sys,
    NULL::STRUCT(cost BIGINT, audit VARCHAR) AS u, NULL::STRUCT(cost BIGINT, audit VARCHAR) AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, n, {_edit("none", 4, "D")}, {_least(_edit("sys", 4, "D"), _keep("none", "s"))},
    {_least(_edit("u", 4, "D"), *(f(s, *x) for s in ("none", "sys", "a") for f, x in ((_keep, ("u",)), (_role, ()))))},
    {_least(_edit("a", 4, "D"), _keep("u", "a"), _role("u"))}
  FROM (
    SELECT conv_id, n, none, sys, u, {_least("a", _edit("u", 3, "I"))} AS a, initial, due, charge
    FROM (SELECT s.conv_id, t.n, none, sys, {_WRITTEN} AS u, a, initial, due, charge FROM states s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.n = s.n + 1)
  )
), ended AS (
  SELECT conv_id, n, {_least("none", "a", _edit("u", 3, "I"))} AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS back FROM states) WHERE back = 1
), letters AS (
  SELECT conv_id, k, best.audit[k] AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS k FROM ended)
), located AS (
  SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER run AS n, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER run AS place
  FROM letters WINDOW run AS (PARTITION BY conv_id ORDER BY k)
), written AS (
  SELECT l.conv_id, l.k, l.letter, l.place, CASE WHEN letter <> 'I' THEN t.role END AS role, CASE WHEN letter = 'I' THEN '' ELSE t.text END AS text,
    max(CASE WHEN place = 1 AND letter = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM located l LEFT JOIN turns t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.n = t.n WHERE letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS lines
  FROM written GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON e.conv_id IS NOT DISTINCT FROM r.conv_id
"""
