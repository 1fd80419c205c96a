"""The same inputs and results in plain SQL, used to check the Spark queries.

Fragments are common table expressions; `with_parts` prepends those a query needs.
"""

from __future__ import annotations

YEAR = "CASE WHEN doc_id % 2 = 0 THEN 1870 ELSE 1880 END"
FIRST = r"NULLIF(regexp_extract(text, '^\W*(\w+)', 1), '')"
LAST = r"NULLIF(regexp_extract(text, '(\w+)\W*$', 1), '')"

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": (
        (),
        f"""
        SELECT 'DOC-' || ({YEAR}) || '-' || doc_id AS mention_id,
               CASE WHEN doc_id % 31 = 0 THEN 'SRC_OTHER' ELSE 'SRC_' || ({YEAR}) END AS source,
               {YEAR} AS source_year,
               CASE WHEN doc_id % 17 <> 0 THEN CAST(n_chars AS INTEGER) END AS birth_year,
               {FIRST} AS first_name,
               CASE WHEN copy = 1 THEN 'copy' WHEN doc_id % 3 <> 0 THEN lang END AS middle_name,
               {LAST} AS last_name,
               CASE WHEN doc_id % 19 <> 0 THEN upper({FIRST}) END AS norm_first_name,
               upper({LAST}) AS nysiis_last_name,
               lang AS race,
               CASE WHEN doc_id % 23 <> 0 THEN lang END AS norm_race,
               CASE WHEN contains(text, chr(10)) THEN 'M' ELSE 'F' END AS gender,
               source AS occupation,
               upper(source) AS norm_occupation,
               CAST(0.9 AS DOUBLE) AS confidence,
               doc_id * 2 + copy AS row_order
        FROM documents JOIN (VALUES (0), (1)) AS c(copy) ON copy = 0 OR doc_id % 29 = 0""",
    ),
    "prepared": (
        ("raw",),
        """
        SELECT mention_id AS unique_id, source_year, birth_year, upper(middle_name) AS middle_name,
               norm_first_name, nysiis_last_name, norm_race, gender, norm_occupation
        FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY row_order) AS rn
              FROM raw WHERE source = 'SRC_1870' OR source = 'SRC_1880') WHERE rn = 1""",
    ),
    "lft": (("prepared",), "SELECT * FROM prepared WHERE source_year = 1870"),
    "rgt": (("prepared",), "SELECT * FROM prepared WHERE source_year = 1880"),
    "worded": (
        (),
        f"""
        SELECT doc_id, lang, source, n_chars, doc_id % 2 AS side, upper({FIRST}) AS first, upper({LAST}) AS last,
               md5(text) AS text_hash, contains(text, chr(10)) AS broken
        FROM documents""",
    ),
    "assertions": (
        ("worded",),
        """
        SELECT 'DOC-' || (CASE WHEN side = 0 THEN 1870 ELSE 1880 END) || '-' || doc_id AS subject_id,
               'DOC-' || (CASE WHEN side = 0 THEN 1870 ELSE 1880 END) || '-' || head AS object_id,
               predicate, source AS who
        FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, side, first) AS head,
                     CASE doc_id % 4 WHEN 0 THEN 'child_of' WHEN 1 THEN 'spouse_of'
                                     WHEN 2 THEN 'sibling_of' ELSE 'lodges_with' END AS predicate
              FROM worded WHERE first IS NOT NULL
              UNION ALL
              SELECT *, min(doc_id) OVER (PARTITION BY lang, side, last) AS head, 'kin_of' AS predicate
              FROM worded WHERE last IS NOT NULL)
        WHERE doc_id <> head""",
    ),
    "truth": (
        ("worded",),
        """
        SELECT l AS "1870_line", r AS "1880_line", CAST(75 + 105 * ((l // 2) % 5) AS INTEGER) AS score, confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY confidence DESC, l) AS rank_r
              FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY confidence DESC, r) AS rank_l
                    FROM (SELECT min(doc_id) FILTER (side = 0) AS l, min(doc_id) FILTER (side = 1) AS r, 3 AS confidence
                          FROM worded GROUP BY text_hash
                          UNION ALL
                          SELECT min(doc_id) FILTER (side = 0), min(doc_id) FILTER (side = 1), 2
                          FROM worded GROUP BY first, last
                          UNION ALL
                          SELECT min(doc_id) FILTER (side = 0), min(doc_id) FILTER (side = 1), 1
                          FROM worded GROUP BY lang, first
                          UNION ALL
                          SELECT min(doc_id) FILTER (side = 0), min(doc_id) FILTER (side = 1), 0
                          FROM worded GROUP BY lang, broken, n_chars // 6)
                    WHERE l IS NOT NULL AND r IS NOT NULL)
              WHERE rank_l = 1)
        WHERE rank_r = 1""",
    ),
    "truth_ids": (
        ("truth",),
        """SELECT *, 'DOC-1870-' || "1870_line" AS id_1870, 'DOC-1880-' || "1880_line" AS id_1880 FROM truth""",
    ),
}

# The two blocking rules of the linkage, and below the levels of its comparisons.
RULE_NAME = "l.norm_first_name = r.norm_first_name AND l.nysiis_last_name = r.nysiis_last_name"
RULE_RANGE = "l.norm_race = r.norm_race AND l.gender = r.gender AND abs(l.birth_year - r.birth_year) <= 5"
PAIR_IDS = "l.unique_id AS unique_id_l, r.unique_id AS unique_id_r"
NUMBER_OF = "CAST(count(*) AS BIGINT)"

GAMMA = {
    "birth_year": """CASE WHEN l.birth_year IS NULL OR r.birth_year IS NULL THEN -1
        WHEN abs(l.birth_year - r.birth_year) = 0 THEN 4 WHEN abs(l.birth_year - r.birth_year) <= 1 THEN 3
        WHEN abs(l.birth_year - r.birth_year) <= 2 THEN 2 WHEN abs(l.birth_year - r.birth_year) <= 5 THEN 1 ELSE 0 END""",
    "norm_race": """CASE WHEN l.norm_race IS NULL OR r.norm_race IS NULL THEN -1
        WHEN l.norm_race = r.norm_race THEN 1 ELSE 0 END""",
    "gender": "CASE WHEN l.gender IS NULL OR r.gender IS NULL THEN -1 WHEN l.gender = r.gender THEN 1 ELSE 0 END",
    "norm_first_name": """CASE WHEN l.norm_first_name IS NULL OR r.norm_first_name IS NULL THEN -1
        WHEN levenshtein(l.norm_first_name, r.norm_first_name) = 0 THEN 4
        WHEN levenshtein(l.norm_first_name, r.norm_first_name) = 1 THEN 3
        WHEN levenshtein(l.norm_first_name, r.norm_first_name) = 2 THEN 2
        WHEN substr(l.norm_first_name, 1, 1) = substr(r.norm_first_name, 1, 1) THEN 1 ELSE 0 END""",
}
GAMMAS = ", ".join(f"CAST({sql} AS INTEGER) AS gamma_{name}" for name, sql in GAMMA.items())

PARTS["blocked"] = (
    ("lft", "rgt"),
    f"""
    SELECT {PAIR_IDS}, 0 AS match_key, {GAMMAS} FROM lft l JOIN rgt r ON {RULE_NAME}
    UNION ALL
    SELECT {PAIR_IDS}, 1 AS match_key, {GAMMAS} FROM lft l JOIN rgt r ON {RULE_RANGE}
    WHERE NOT coalesce({RULE_NAME}, false)""",
)

BUCKET = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


def _sample(max_pairs: int) -> tuple[str, str, str]:
    """Random pairs by hash bucket, cut to the smallest hashes of both ids."""
    whole = "(SELECT count(*) FROM lft) * (SELECT count(*) FROM rgt)"
    h_l, h_r = BUCKET.format("l.unique_id"), BUCKET.format("r.unique_id")
    mark = BUCKET.format("l.unique_id || '|' || r.unique_id")
    # A quarter more pairs than asked for are drawn, halving the buckets until they suffice.
    first = f"greatest(1, CAST(floor({whole} / ({max_pairs} * 1.25::DOUBLE)) AS BIGINT))"
    return f"""
    SELECT * EXCLUDE (place) FROM (
        SELECT {PAIR_IDS}, {GAMMAS}, row_number() OVER (ORDER BY {mark}, l.unique_id, r.unique_id) AS place
        FROM lft l JOIN rgt r ON {h_l} % (SELECT b FROM enough) = {h_r} % (SELECT b FROM enough))
    WHERE place <= {max_pairs}""", f"""
    SELECT max(b) AS b FROM (
        SELECT b, sum(n_l * n_r) AS n FROM
          (SELECT b, {BUCKET.format('unique_id')} % b AS k, count(*) AS n_l FROM lft, tries GROUP BY ALL)
          JOIN (SELECT b, {BUCKET.format('unique_id')} % b AS k, count(*) AS n_r FROM rgt, tries GROUP BY ALL) USING (b, k) GROUP BY b)
    WHERE n >= {max_pairs} OR b = 1""", f"SELECT DISTINCT greatest(1, {first} // (1 << i)) AS b FROM range(0, 6) t(i)"


def sample_parts(max_pairs: int, name: str = "sampled") -> dict[str, str]:
    """Common table expressions for the sample, in order."""
    pairs, enough, tries = (text.replace("FROM enough", f"FROM {name}_enough").replace(", tries", f", {name}_tries") for text in _sample(max_pairs))
    return {f"{name}_tries": tries, f"{name}_enough": enough, name: pairs}


for _name, _text in sample_parts(1_000_000).items():
    PARTS[_name] = ({"sampled_tries": ("lft", "rgt"), "sampled_enough": ("sampled_tries",), "sampled": ("sampled_enough",)}[_name], _text)


def with_parts(select: str, *needed: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause holding the needed parts (and what they need) in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for below in PARTS[name][0]:
            visit(below)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    parts = [(n, PARTS[n][1]) for n in order] + list((extra or {}).items())
    looping = [name for name, _ in parts if name.startswith("reach")]
    text = ",\n".join(f"{name} AS {'' if name in looping else 'MATERIALIZED '}({sql}\n)" for name, sql in parts)
    recursive = "RECURSIVE " if looping else ""
    return f"WITH {recursive}{text}\n{select}" if parts else select


# -- scoring with stated parameters ----------------------------------------------------------------


def weight_sql(rates: dict[str, dict[int, tuple[float, float]]], prior: float, prefix: str = "") -> str:
    """log2 odds of a gamma row under (m, u) per level; the null level adds nothing."""
    terms = [f"log2({prior!r}::DOUBLE / (1 - {prior!r}::DOUBLE))"]
    for name, levels in rates.items():
        cases = " ".join(f"WHEN {g} THEN log2({m!r}::DOUBLE / {u!r}::DOUBLE)" for g, (m, u) in levels.items())
        terms.append(f"CASE {prefix}gamma_{name} {cases} ELSE 0 END")
    return " + ".join(terms)


def scored_part(source: str, weight: str, threshold: float | None) -> str:
    cut = "" if threshold is None else f" WHERE match_probability >= {threshold}"
    return f"""
    SELECT * FROM (SELECT *, 1 / (1 + pow(2::DOUBLE, -match_weight)) AS match_probability
                   FROM (SELECT *, {weight} AS match_weight FROM {source})){cut}"""


# -- training unrolled -------------------------------------------------------------------------------

LEVELS = {"birth_year": 4, "norm_race": 1, "gender": 1, "norm_first_name": 4}


def level_values(names: list[str]) -> str:
    rows = ", ".join(f"('{n}', {g})" for n in names for g in range(LEVELS[n], -1, -1))
    return f"(VALUES {rows}) AS v(comparison, level)"


def u_part(source: str = "sampled") -> str:
    """Level shares of random pairs, floored."""
    unions = " UNION ALL ".join(f"SELECT '{n}' AS comparison, gamma_{n} AS level FROM {source}" for n in LEVELS)
    return f"""
    SELECT v.comparison, v.level,
           greatest(coalesce(n::DOUBLE / sum(n) OVER (PARTITION BY v.comparison), 0), 1e-9) AS u
    FROM {level_values(list(LEVELS))}
    LEFT JOIN (SELECT comparison, level, count(*) AS n FROM ({unions}) WHERE level >= 0 GROUP BY ALL) c
      ON c.comparison = v.comparison AND c.level = v.level"""


def prior_part(recall: float = 0.9) -> str:
    return f"""
    SELECT rule_pairs, all_pairs, rule_pairs / {recall}::DOUBLE / all_pairs AS prior
    FROM (SELECT (SELECT count(*) FROM lft l JOIN rgt r
                  ON l.gender = r.gender AND l.norm_race = r.norm_race AND l.norm_first_name = r.norm_first_name) AS rule_pairs,
                 (SELECT count(*) FROM lft) * (SELECT count(*) FROM rgt) AS all_pairs)"""


def session_parts(tag: str, condition: str, names: list[str], rounds: int) -> dict[str, str]:
    """EM on one training block, one common table expression per half-round."""
    gammas = ", ".join(f"{GAMMA[n]} AS gamma_{n}" for n in names)
    parts = {
        f"pat_{tag}": f"""
        SELECT {', '.join(f'gamma_{n}' for n in names)}, count(*) AS pairs
        FROM (SELECT {gammas} FROM lft l JOIN rgt r ON {condition}) GROUP BY ALL""",
        f"m_{tag}_0": f"""
        SELECT comparison, level, CASE WHEN level = top THEN 0.9::DOUBLE ELSE (1 - 0.9::DOUBLE) / top END AS m
        FROM (SELECT *, max(level) OVER (PARTITION BY comparison) AS top FROM {level_values(names)})""",
        f"lam_{tag}_0": f"""
        SELECT least(0.5::DOUBLE, (SELECT prior * all_pairs FROM prior_est) / (SELECT sum(pairs) FROM pat_{tag})) AS lam""",
    }
    # Rounds after the first small change keep what they find; `n` counts the others.
    parts[f"end_{tag}_0"] = "SELECT 0 AS n, NULL::DOUBLE AS change, false AS settled"
    for k in range(1, rounds + 1):
        joins = "".join(
            f"\n LEFT JOIN m_{tag}_{k - 1} m_{n} ON m_{n}.comparison = '{n}' AND m_{n}.level = p.gamma_{n}"
            f"\n LEFT JOIN u_est u_{n} ON u_{n}.comparison = '{n}' AND u_{n}.level = p.gamma_{n}"
            for n in names
        )
        m_product = " * ".join(f"coalesce(m_{n}.m, 1)" for n in names)
        u_product = " * ".join(f"coalesce(u_{n}.u, 1)" for n in names)
        lam = f"(SELECT lam FROM lam_{tag}_{k - 1})"
        settled = f"(SELECT settled FROM end_{tag}_{k - 1})"
        parts[f"w_{tag}_{k}"] = f"""
        SELECT p.*, pairs * ({lam} * {m_product}) / ({lam} * {m_product} + (1 - {lam}) * {u_product}) AS w
        FROM pat_{tag} p{joins}"""
        unions = " UNION ALL ".join(f"SELECT '{n}' AS comparison, gamma_{n} AS level, w FROM w_{tag}_{k}" for n in names)
        parts[f"m_{tag}_{k}"] = f"""
        SELECT o.comparison, o.level, CASE WHEN {settled} THEN o.m ELSE
               greatest(coalesce(mass / sum(mass) OVER (PARTITION BY o.comparison), 0), 1e-9) END AS m
        FROM m_{tag}_{k - 1} o
        LEFT JOIN (SELECT comparison, level, sum(w) AS mass FROM ({unions}) WHERE level >= 0 GROUP BY ALL) c
          ON c.comparison = o.comparison AND c.level = o.level"""
        parts[f"lam_{tag}_{k}"] = f"SELECT CASE WHEN {settled} THEN {lam} ELSE sum(w) / sum(pairs) END AS lam FROM w_{tag}_{k}"
        parts[f"end_{tag}_{k}"] = f"""
        SELECT e.n + CAST(NOT e.settled AS INTEGER) AS n, CASE WHEN e.settled THEN e.change ELSE d.change END AS change,
               e.settled OR d.change < 1e-4 AS settled
        FROM end_{tag}_{k - 1} e, (SELECT max(abs(a.m - b.m)) AS change FROM m_{tag}_{k} a
                                   JOIN m_{tag}_{k - 1} b USING (comparison, level)) d"""
    return parts


# The default training stops at a change below 1e-4 or after so many rounds.
ROUNDS = 25
SESSIONS = {
    "g": ("gender equal", "l.gender = r.gender", ["birth_year", "norm_race", "norm_first_name"]),
    "rf": (
        "norm_race equal and norm_first_name equal",
        "l.norm_race = r.norm_race AND l.norm_first_name = r.norm_first_name",
        ["birth_year", "gender"],
    ),
}


def training_parts() -> dict[str, str]:
    parts = {"prior_est": prior_part(), "u_est": u_part()}
    for tag, (_, condition, names) in SESSIONS.items():
        parts |= {k: f"{v}" for k, v in session_parts(tag, condition, names, ROUNDS).items()}
    parts["sessions"] = " UNION ALL ".join(
        f"""
        SELECT '{label}' AS session, m.comparison, m.level, m.m, (SELECT lam FROM lam_{tag}_{ROUNDS}) AS prior,
               (SELECT n FROM end_{tag}_{ROUNDS}) AS rounds, (SELECT change FROM end_{tag}_{ROUNDS}) AS last_change
        FROM m_{tag}_{ROUNDS} m"""
        for tag, (label, _, _) in SESSIONS.items()
    )
    parts["model"] = """
        SELECT comparison, level, m, u, log2(m / u) AS weight
        FROM (SELECT comparison, level, avg(m) AS m FROM sessions GROUP BY ALL) JOIN u_est USING (comparison, level)"""
    return parts


def trained_weight() -> str:
    """Weight of a `blocked` row under the trained model."""
    terms = ["(SELECT log2(prior / (1 - prior)) FROM prior_est)"]
    terms += [
        f"coalesce((SELECT weight FROM model WHERE comparison = '{n}' AND level = gamma_{n}), 0)" for n in LEVELS
    ]
    return " + ".join(terms)
