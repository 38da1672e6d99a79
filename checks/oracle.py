"""The same answers in plain SQL, for DuckDB to run over the same tables.

totals as windows over a union of both corners.
"""

from __future__ import annotations

from boutlab.fixtures import CUTOFF
from boutlab.functions.text import LETTER_PAIRS
from boutlab.operators.features import NUMERIC_FEATURES
from boutlab.schema import (
    AREAS,
    CATEGORIES,
    CORNER_FEATURES,
    FEATURES,
    RECORD,
    STAT_COLUMNS,
    STRIKES,
    TOTAL_COLUMNS,
    VOCABULARY,
    WEIGHT_CLASSES,
)

DAY = f"DATE '{CUTOFF}'"

TITLES = ", ".join(f"'{n.title()}'" for n in WEIGHT_CLASSES)
POUNDS = " ".join(f"WHEN '{n}' THEN {p}" for n, p in WEIGHT_CLASSES.items())


def pounds(text):
    return f"CAST(CASE {text} {POUNDS} END AS INTEGER)"


CTE = {
    "ev": """
SELECT event_id, ts, user_id, value, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k
FROM events""",
    "bouts": f"""
SELECT a.event_id // 2 AS bout_id, a.ts AS bout_ts, CAST(a.ts AS DATE) AS bout_date,
  a.user_id AS r_id, b.user_id AS b_id, 'user ' || a.user_id AS r_name, 'user ' || b.user_id AS b_name,
  CASE WHEN floor(a.value) = floor(b.value) THEN '' WHEN a.value > b.value THEN 'user ' || a.user_id
    ELSE 'user ' || b.user_id END AS winner,
  (['Decision - Split', 'Decision - Unanimous', 'KO/TKO', 'Submission', 'Overturned'])[(a.k + b.k) % 5 + 1]
    AS win_method,
  a.event_type = 'signup' AS championship_fight, a.k AS rk, b.k AS bk,
  CASE WHEN a.event_type = 'signup' THEN 5 ELSE 3 END AS number_of_rounds,
  CAST((a.k + b.k) % CASE WHEN a.event_type = 'signup' THEN 5 ELSE 3 END + 1 AS INTEGER) AS finish_round,
  CAST(a.k * 7 % 300 AS INTEGER) AS finish_seconds,
  printf('%d:%02d', (a.k * 7 % 300) // 60, (a.k * 7 % 300) % 60) AS finish_time,
  ([{TITLES}])[a.event_id // 2 % 10 + 1] AS weight_class
FROM ev a JOIN ev b ON b.event_id = a.event_id + 1
WHERE a.event_id % 2 = 0 AND a.user_id <> b.user_id""",
    "sides": """
SELECT bout_id, bout_ts, bout_date, 'r' AS corner, r_id AS competitor_id, b_id AS opponent_id,
  r_name AS name, b_name AS opponent, winner, championship_fight, finish_round, finish_seconds,
  rk AS k, bout_id * 2 AS stats_id FROM bouts
UNION ALL
SELECT bout_id, bout_ts, bout_date, 'b', b_id, r_id, b_name, r_name, winner, championship_fight,
  finish_round, finish_seconds, bk, bout_id * 2 + 1 FROM bouts""",
    "competitors": """
SELECT id, 'user ' || id AS name, CAST(id % 90 + 115 AS INTEGER) AS weight,
  CAST(60 + id % 20 AS INTEGER) AS height,
  CASE WHEN id % 6 <> 0 THEN CAST(60 + id % 20 + id % 5 AS INTEGER) END AS reach,
  (['Orthodox', 'Southpaw', 'Switch', 'Open Stance', NULL])[id % 5 + 1] AS stance,
  CAST(DATE '1980-01-01' + CAST(37 * id % 7000 AS INTEGER) AS DATE) AS date_of_birth,
  CASE WHEN id % 4 = 0 THEN 'female' ELSE 'male' END AS gender
FROM (SELECT DISTINCT user_id AS id FROM events)""",
    "raw": f"""
SELECT id, name, height AS h, weight AS w, reach AS re, stance AS st, date_of_birth AS dob, gender,
  CASE WHEN id % 2 = 0 THEN '"' ELSE '&quot;' END AS mark,
  ([{TITLES}])[id % 10 + 1] AS class_title,
  id % 17 = 3 AS no_height, id % 19 = 4 AS no_weight
FROM competitors""",
    "quotes": """
SELECT q.bout_id AS quote_id,
  CASE WHEN q.bout_id % 89 <> 0 THEN CASE WHEN q.bout_id % 3 = 0 THEN b_name ELSE rn END END AS left_name,
  CASE WHEN q.bout_id % 3 = 0 THEN rn ELSE b_name END AS right_name,
  CASE WHEN q.bout_id % 3 = 0 THEN bo ELSE ro END AS left_odds,
  CASE WHEN q.bout_id % 3 = 0 THEN ro ELSE bo END AS right_odds,
  weight_class,
  CAST(CASE WHEN q.bout_id % 13 = 0 THEN bout_date + 365 ELSE bout_date END AS DATE) AS quote_date,
  CASE WHEN q.bout_id % 5 = 0 THEN q.bout_id END AS bout_id
FROM (SELECT *, CASE WHEN bout_id % 7 = 0 THEN 'usr ' || r_id ELSE r_name END AS rn,
        CASE WHEN rk >= bk THEN '-' || (100 + 3 * rk) ELSE '+' || (100 + 3 * bk) END AS ro,
        CASE WHEN rk >= bk THEN '+' || (100 + 3 * rk) ELSE '-' || (100 + 3 * bk) END AS bo
      FROM bouts WHERE bout_id % 11 <> 0) q""",
    "resolved": """
SELECT * REPLACE (CASE WHEN left_name LIKE 'usr %' THEN 'user ' || substr(left_name, 5) ELSE left_name END AS left_name,
  CASE WHEN right_name LIKE 'usr %' THEN 'user ' || substr(right_name, 5) ELSE right_name END AS right_name)
FROM quotes""",
    "matched": """
SELECT q.quote_id, min(b.bout_id) AS bout_id FROM resolved q JOIN bouts b
  ON ((q.left_name = b.r_name AND q.right_name = b.b_name) OR (q.left_name = b.b_name AND q.right_name = b.r_name))
  AND q.quote_date = b.bout_date
GROUP BY q.quote_id""",
    "oriented": """
SELECT m.quote_id, m.bout_id,
  CASE WHEN q.left_name = b.r_name THEN q.left_odds ELSE q.right_odds END AS r_odds,
  CASE WHEN q.left_name = b.r_name THEN q.right_odds ELSE q.left_odds END AS b_odds,
  q.weight_class
FROM matched m JOIN resolved q USING (quote_id) JOIN bouts b ON b.bout_id = m.bout_id""",
    "newest": """
SELECT * FROM oriented o WHERE quote_id = (SELECT max(p.quote_id) FROM oriented p WHERE p.bout_id = o.bout_id)""",
    "linked": f"""
SELECT *, CASE WHEN bout_date <= {DAY} OR bout_id % 13 = 0 THEN bout_id * 2 END AS r_totals_id,
  CASE WHEN bout_date <= {DAY} OR bout_id % 13 = 0 THEN bout_id * 2 + 1 END AS b_totals_id
FROM bouts""",
    "linked_sides": """
SELECT bout_id, bout_date, 'r' AS corner, r_id AS competitor_id, b_id AS opponent_id, r_totals_id AS totals_id FROM linked
UNION ALL SELECT bout_id, bout_date, 'b', b_id, r_id, b_totals_id FROM linked""",
    "unresolved": """
SELECT bout_id, bout_date, CASE WHEN bout_id % 17 = 0 THEN 'guest ' || bout_id ELSE r_name END AS r_name, b_name,
  CASE WHEN bout_id % 2 = 0 THEN r_id END AS r_id, CASE WHEN bout_id % 2 = 0 THEN b_id END AS b_id,
  CASE WHEN bout_id % 3 = 0 THEN bout_id END AS quote_id
FROM bouts""",
    "card": """
SELECT bout_id AS card_id, r_id, b_id, r_name, b_name, bout_date, weight_class FROM bouts
WHERE bout_date = (SELECT max(bout_date) FROM bouts)""",
    "labels_of": """
SELECT bout_id, bout_date, CASE WHEN winner = '' THEN 'DRAW' WHEN winner = r_name THEN 'Red' ELSE 'Blue' END AS winner
FROM bouts""",
    "predicted": """
SELECT b.bout_id, CASE WHEN winner = '' THEN 2 WHEN winner = r_name THEN 0 ELSE 1 END AS label,
  (rk + bk) % 2 AS prediction,
  CASE WHEN b.bout_id % 4 = 0 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN b.bout_id % 11 = 0 THEN NULL WHEN rk >= bk THEN -(100 + 3 * rk) ELSE 100 + 3 * bk END AS r_odds,
  CASE WHEN b.bout_id % 11 = 0 THEN NULL WHEN rk >= bk THEN 100 + 3 * rk ELSE -(100 + 3 * bk) END AS b_odds
FROM bouts b""",
    "won": """
SELECT *, CASE WHEN label IS NULL THEN NULL
  WHEN prediction = 0 AND r_odds IS NULL OR prediction = 1 AND b_odds IS NULL THEN NULL
  WHEN label <> prediction THEN -1.0
  WHEN label = 0 THEN CASE WHEN r_odds > 0 THEN r_odds / 100.0 ELSE abs(100.0 / r_odds) END
  WHEN label = 1 THEN CASE WHEN b_odds > 0 THEN b_odds / 100.0 ELSE abs(100.0 / b_odds) END
  ELSE 0.0 END AS units
FROM predicted""",
}

# Which earlier parts each part reads.
NEEDS = {
    "bouts": ["ev"], "sides": ["bouts"], "raw": ["competitors"], "quotes": ["bouts"],
    "resolved": ["quotes"], "matched": ["resolved", "bouts"], "oriented": ["matched", "resolved", "bouts"],
    "newest": ["oriented"], "linked": ["bouts"], "linked_sides": ["linked"], "unresolved": ["bouts"],
    "card": ["bouts"], "labels_of": ["bouts"], "predicted": ["bouts"], "won": ["predicted"],
}


def _factor_pair(name):
    if name in AREAS:
        return AREAS.index(name) + 3, None
    n = int(name.split("_")[1])
    return n + 11, n


def stat_texts(k="k", finish="finish_round"):
    """Statistics of a corner from its k."""
    texts = {}
    for c in CATEGORIES:
        factor, n = _factor_pair(c)
        tried, hit = f"{k} * {factor} % 60", f"({k} * {factor} % 60) * ({k} % 10) // 10"
        for part, text in (("landed", hit), ("attempted", tried)):
            if n:
                text = f"CASE WHEN {finish} >= {n} THEN {text} END"
            texts[f"{c}_{part}"] = f"CAST({text} AS INTEGER)"
    texts["kd_landed"] = f"CAST({k} % 3 AS INTEGER)"
    texts["subs_attempted"] = f"CAST({k} % 4 AS INTEGER)"
    texts["ctrl_time"] = f"CAST({k} * 3 AS INTEGER)"
    texts["reversals"] = f"CAST({k} % 2 AS INTEGER)"
    return texts


CTE["stats"] = "\nSELECT stats_id, bout_id, corner, competitor_id, " + ", ".join(
    f"{t} AS {n}" for n, t in stat_texts().items()
) + " FROM sides"
NEEDS["stats"] = ["sides"]


def _increments():
    """One row per corner with what the bout adds to each total, opponents' own totals aside."""
    texts = {
        "wins": "CASE WHEN winner = name THEN 1 ELSE 0 END",
        "losses": "CASE WHEN winner = opponent THEN 1 ELSE 0 END",
        "draws": "CASE WHEN winner = '' THEN 1 ELSE 0 END",
        "championship_fights": "CASE WHEN championship_fight THEN 1 ELSE 0 END",
        "fight_time": "(finish_round - 1) * 300 + finish_seconds",
    }
    for c in CATEGORIES:
        texts[f"{c}_landed"] = f"coalesce(s.{c}_landed, 0)"
        texts[f"{c}_attempted"] = f"coalesce(s.{c}_attempted, 0)"
        texts[f"{c}_absorbed"] = f"coalesce(o.{c}_landed, 0)"
        texts[f"{c}_evaded"] = f"coalesce(o.{c}_attempted, 0) - coalesce(o.{c}_landed, 0)"
    texts |= {
        "kd_landed": "s.kd_landed", "kd_absorbed": "o.kd_landed",
        "subs_attempted": "s.subs_attempted", "subs_evaded": "o.subs_attempted",
        "ctrl_time": "s.ctrl_time", "opponent_ctrl_time": "o.ctrl_time", "reversals": "s.reversals",
    }
    return texts


def legs(where="TRUE"):
    columns = ", ".join(f"{t} AS {n}" for n, t in _increments().items())
    return f"""
SELECT x.bout_id, x.bout_ts, x.bout_date, x.corner, x.competitor_id, x.opponent_id, x.name, {columns}
FROM sides x JOIN stats s ON s.stats_id = x.stats_id
JOIN stats o ON o.bout_id = x.bout_id AND o.corner <> x.corner WHERE {where}"""


CTE["legs"] = legs()
NEEDS["legs"] = ["sides", "stats"]

UP_TO = "OVER (PARTITION BY competitor_id ORDER BY bout_ts, bout_id ROWS UNBOUNDED PRECEDING)"
BEFORE_SUMS = {"opponent_wins": "wins", "opponent_loses": "losses", "opponent_fight_time": "fight_time"}


def met(source):
    own = ", ".join(f"sum({n}) {UP_TO} - {n} AS {n}" for n in BEFORE_SUMS.values())
    got = ", ".join(f"e.{n} AS {t}" for t, n in BEFORE_SUMS.items())
    return f"""
SELECT l.*, {got} FROM {source} l JOIN (SELECT bout_id, competitor_id AS cid, {own} FROM {source}) e
  ON e.bout_id = l.bout_id AND e.cid = l.opponent_id"""


def totals_of(source, before=False):
    less = "- {0}" if before else ""
    sums = ", ".join(
        f"CAST(sum({n}) {UP_TO} {less.format(n)} AS BIGINT) AS {n}" for n in TOTAL_COLUMNS
    )
    return f"""
SELECT bout_id, bout_ts, bout_date, corner, competitor_id, name,
  bout_id * 2 + CASE corner WHEN 'r' THEN 0 ELSE 1 END AS totals_id, {sums} FROM {source}"""


CTE["met"] = met("legs")
NEEDS["met"] = ["legs"]
CTE["totals"] = totals_of("met")
NEEDS["totals"] = ["met"]
CTE["entering"] = totals_of("met", before=True)
NEEDS["entering"] = ["met"]

_BODY = ("stance", "height", "reach")


def _wide(source):
    """Columns of a model row from corner rows r and b and competitors cr and cb."""
    columns = []
    for name in FEATURES:
        if name == "weight":
            columns.append(f"{pounds('lower(x.weight_class)')} AS weight")
        elif name == "gender":
            columns.append("cr.gender AS gender")
        else:
            side, column = name.split("_", 1)
            if column == "age":
                text = f"CAST(x.bout_date - c{side}.date_of_birth AS INTEGER)"
            elif column == "reach":
                text = f"coalesce(c{side}.reach, c{side}.height)"
            elif column in _BODY:
                text = f"c{side}.{column}"
            else:
                text = f"{side}.{column}"
            columns.append(f"{text} AS {name}")
    return ", ".join(columns)


def dataset(source):
    return f"""
SELECT x.bout_id, x.bout_date, x.win_method, {_wide(source)}, l.winner,
  CAST(p.r_odds AS INTEGER) AS r_odds, CAST(p.b_odds AS INTEGER) AS b_odds
FROM bouts x JOIN {source} r ON r.bout_id = x.bout_id AND r.corner = 'r'
JOIN {source} b ON b.bout_id = x.bout_id AND b.corner = 'b'
JOIN competitors cr ON cr.id = x.r_id JOIN competitors cb ON cb.id = x.b_id
JOIN labels_of l ON l.bout_id = x.bout_id JOIN predicted p ON p.bout_id = x.bout_id"""


CTE["dataset"] = dataset("entering")
NEEDS["dataset"] = ["bouts", "entering", "competitors", "labels_of", "predicted"]

# Totals before the card: those of each competitor's last bout on an earlier day.
CTE["past"] = "\nSELECT * FROM totals WHERE bout_date < (SELECT max(bout_date) FROM bouts)"
NEEDS["past"] = ["totals", "bouts"]
CTE["newest_totals"] = """
SELECT * FROM past WHERE totals_id IN (SELECT max(totals_id) FROM past GROUP BY competitor_id)"""
NEEDS["newest_totals"] = ["past"]
CTE["matchups"] = f"""
SELECT x.card_id, x.r_name, x.b_name, x.r_id, x.b_id, r.totals_id AS r_totals_id, b.totals_id AS b_totals_id,
  x.bout_date, {_wide('newest_totals')}
FROM card x LEFT JOIN newest_totals r ON r.competitor_id = x.r_id
LEFT JOIN newest_totals b ON b.competitor_id = x.b_id
LEFT JOIN competitors cr ON cr.id = x.r_id LEFT JOIN competitors cb ON cb.id = x.b_id"""
NEEDS["matchups"] = ["card", "newest_totals", "competitors"]

CTE["early"] = """
SELECT competitor_id, max(totals_id) AS totals_id FROM (
  SELECT competitor_id, bout_id * 2 + CASE corner WHEN 'r' THEN 0 ELSE 1 END AS totals_id
  FROM sides WHERE bout_date <= DATE '2024-01-01') GROUP BY competitor_id"""
NEEDS["early"] = ["sides"]

CTE["pending_sides"] = f"""
SELECT * FROM sides WHERE bout_date > {DAY} AND bout_id % 13 <> 0"""
NEEDS["pending_sides"] = ["sides"]


def _ordered(names):
    seen = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in seen:
            seen.append(name)

    for n in names:
        add(n)
    return seen


def sql(needs, body, extra=None):
    parts = [f"{n} AS ({CTE[n]})" for n in _ordered(needs)]
    parts += [f"{n} AS ({t})" for n, t in (extra or {}).items()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body


CORNER = "bout_id, corner, competitor_id"


def _increment_sql(columns, stored, pending, final):
    """Totals of pending bouts: the latest stored totals before each, plus a running sum over the legs
    that start from the same stored row.

    ``stored`` and ``pending`` are conditions on a side's bout.
    """
    extra = {
        "old_legs": legs(stored), "old_met": met("old_legs"), "old_totals": totals_of("old_met"),
        "raw_legs": legs(pending),
        "new_legs": "SELECT l.*, coalesce(o.totals_id, -1) AS seg FROM raw_legs l ASOF LEFT JOIN old_totals o "
        "ON o.competitor_id = l.competitor_id AND o.bout_ts < l.bout_ts",
    }
    own = ", ".join(
        f"coalesce(s.{n}, 0) + sum(l.{n}) OVER (PARTITION BY l.competitor_id, l.seg ORDER BY l.bout_ts, l.bout_id"
        f" ROWS UNBOUNDED PRECEDING) - l.{n} AS {n}" for n in BEFORE_SUMS.values()
    )
    extra["entry"] = (
        f"SELECT l.bout_id, l.competitor_id AS cid, {own} FROM new_legs l "
        "LEFT JOIN old_totals s ON s.totals_id = l.seg"
    )
    got = ", ".join(f"e.{n} AS {t}" for t, n in BEFORE_SUMS.items())
    extra["new_met"] = (
        f"SELECT l.*, {got} FROM new_legs l JOIN entry e ON e.bout_id = l.bout_id AND e.cid = l.opponent_id"
    )
    sums = ", ".join(
        f"CAST(coalesce(s.{n}, 0) + sum(l.{n}) OVER (PARTITION BY l.competitor_id, l.seg ORDER BY l.bout_ts, l.bout_id"
        f" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {n}" for n in TOTAL_COLUMNS
    )
    extra["grown"] = (
        f"SELECT l.bout_id, l.bout_ts, l.bout_date, l.corner, l.competitor_id, {sums} FROM new_legs l "
        "LEFT JOIN old_totals s ON s.totals_id = l.seg"
    ).replace("FROM new_legs", "FROM new_met")
    return sql(["sides", "stats", "competitors"], final, extra)


def _mean_std():
    lines = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM train"
        for c in NUMERIC_FEATURES
    )
    return lines


HASHED = "CAST(('0x' || substr(md5('0:' || bout_id), 1, 8)) AS BIGINT) % 4 = 0"

def _plain(column):
    for letter, pair in LETTER_PAIRS.items():
        column = f"replace({column}, '{letter}', '{pair}')"
    return f"replace(strip_accents({column}), '-', ' ')"


ANCHOR = r"'<a(?:\s[^>]*)?>.*?</a>'"
ITEM = r"'<li(?:\s[^>]*)?>.*?</li>'"


def _strip(text):
    return rf"trim(regexp_replace({text}, '<[^>]*>', '', 'g'))"


ITEMS = rf"""
SELECT page_id, [{_strip('x')} FOR x IN regexp_extract_all(html, {ITEM}, 0, 's')] AS items FROM pages"""


def build() -> dict[str, str]:
    q = {}
    # scans, sources, sinks
    q["scan_pending_bouts"] = sql(["linked"], f"""SELECT bout_id, bout_date, r_id, b_id FROM linked
WHERE bout_date > {DAY} AND r_totals_id IS NULL AND b_totals_id IS NULL""")
    q["scan_pending_quotes"] = sql(["quotes"], f"""SELECT quote_id, left_name, right_name, quote_date FROM quotes
WHERE quote_date > {DAY} AND bout_id IS NULL""")
    q["lookup_by_id"] = sql(["stats", "linked"], f"""SELECT s.* FROM stats s JOIN linked l USING (bout_id)
WHERE l.bout_date > {DAY} AND l.r_totals_id IS NULL""")
    long = ["weight", "r_wins", "b_sig_str_evaded"]
    q["read_feature_csv"] = sql(["dataset"], "SELECT bout_id, gender, r_stance, winner, "
        + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in long) + " FROM dataset")
    q["append_with_keys"] = sql(["bouts", "quotes"], """SELECT bout_ts, bout_id AS source_id, r_id, b_id,
  (SELECT max(quote_id) FROM quotes) + row_number() OVER (ORDER BY bout_ts, bout_id) AS quote_id FROM bouts""")
    q["append_competitors_cut"] = sql(["competitors"], """SELECT name, gender,
  CAST((SELECT max(id) FROM competitors) + row_number() OVER (ORDER BY gender, name) AS BIGINT) AS id FROM competitors""")
    q["append_competitors"] = sql(["competitors"], """SELECT name, weight, gender,
  (SELECT max(id) FROM competitors) + row_number() OVER (ORDER BY substr(md5(name), 1, 8), name) AS id FROM competitors""")
    q["overlay_update"] = sql(["linked"], f"""SELECT bout_id, bout_date,
  CASE WHEN r_totals_id IS NULL AND bout_date > {DAY} THEN bout_id * 10 ELSE r_totals_id END AS r_totals_id,
  CASE WHEN r_totals_id IS NULL AND bout_date > {DAY} THEN CASE WHEN bout_id % 2 = 0 THEN bout_id * 10 + 1 END
    ELSE b_totals_id END AS b_totals_id FROM linked""")
    link = f"""SELECT b.bout_id, n.quote_id, n.r_odds, n.b_odds, {pounds('lower(n.weight_class)')} AS weight
FROM bouts b LEFT JOIN newest n ON n.bout_id = b.bout_id"""
    q["link_quotes_and_bouts"] = sql(["bouts", "newest"], link)
    q["link_bouts_onto_quotes"] = sql(["quotes", "matched"], """SELECT q.quote_id, q.left_name,
  coalesce(m.bout_id, q.bout_id) AS bout_id FROM quotes q LEFT JOIN matched m ON m.quote_id = q.quote_id""")
    q["update_weight_by_pair"] = sql(["bouts", "quotes"], f"""SELECT b.bout_id, b.r_name, b.b_name, b.bout_date,
  max({pounds('lower(q.weight_class)')}) AS weight
FROM bouts b LEFT JOIN quotes q ON q.quote_date = b.bout_date
  AND ((q.left_name = b.r_name AND q.right_name = b.b_name) OR (q.left_name = b.b_name AND q.right_name = b.r_name))
GROUP BY ALL""")
    texts = ("gender", "r_stance", "b_stance")
    exported = ", ".join(c if c in texts else f"CAST({c} AS BIGINT) AS {c}" for c in FEATURES)
    q["export_dataset"] = sql(["dataset"],
        f"SELECT bout_id, bout_date, win_method, {exported}, winner, r_odds, b_odds FROM dataset")
    q["write_prediction_report"] = sql(["bouts"], """SELECT 'Fight: ' || r_name || ' vs ' || b_name || ' Winner: '
  || CASE WHEN rk >= bk THEN r_name ELSE b_name END || ', Confidence: '
  || printf('%.1f', round((greatest(rk, bk) + 100) / 200.0, 3) * 100) || '%' AS value FROM bouts""")

    # pages
    anchors = rf"""SELECT page_id, unnest(e) AS element, generate_subscripts(e, 1) AS n
  FROM (SELECT page_id, regexp_extract_all(html, {ANCHOR}, 0, 's') AS e FROM pages)"""
    q["extract_links"] = rf"""SELECT page_id, CAST(n - 1 AS INTEGER) AS pos,
  regexp_extract(element, '\shref="([^"]*)"', 1) AS href, {_strip('element')} AS text FROM ({anchors})"""
    title = rf"""nullif(regexp_extract(html, '<title>.*?</title>', 0, 's'), '')"""
    ad = rf"""nullif(regexp_extract(html, '<div class="ad">.*?</div>', 0, 's'), '')"""
    q["extract_text_field"] = f"SELECT page_id, {_strip(title)} AS title, {_strip(ad)} AS ad FROM pages"
    q["extract_cells"] = f"""SELECT page_id, CAST(n - 1 AS INTEGER) AS pos, text FROM (
  SELECT page_id, unnest(items) AS text, generate_subscripts(items, 1) AS n FROM ({ITEMS}))"""
    q["nth_cell"] = f"SELECT page_id, items[3] AS text FROM ({ITEMS})"
    q["chunk_cells"] = "SELECT page_id, CAST(row AS INTEGER) AS row, " + ", ".join(
        f"items[row * 4 + {i + 1}] AS cell_{i}" for i in range(4)
    ) + f" FROM (SELECT page_id, items, unnest(range(CAST(ceil(len(items) / 4.0) AS BIGINT))) AS row FROM ({ITEMS}))"
    walk = {
        "edge": "SELECT page_id, (page_id * 7 + 1) % (SELECT count(*) FROM pages) AS target_page_id, url FROM pages",
        "one": "SELECT page_id, target_page_id FROM edge WHERE url LIKE 'https%'",
        "two": "SELECT page_id, target_page_id FROM edge WHERE page_id IN (SELECT target_page_id FROM one)",
    }
    q["follow_links"] = sql([], "SELECT 1 AS step, * FROM one UNION ALL SELECT 2, * FROM two", walk)
    q["linked_page_titles"] = sql([], f"""SELECT page_id, {_strip(title)} AS text FROM pages
WHERE page_id IN (SELECT target_page_id FROM two)""", walk)
    q["flag_marker"] = r"""SELECT page_id,
  list_contains(regexp_extract_all(html, '<a\s(?:[^>]*\s)?href="([^"]*)"', 1), '/to') AS flag FROM pages"""
    q["flag_title_belt"] = sql(["bouts"], "SELECT bout_id AS page_id, championship_fight AS flag FROM bouts")
    q["slice_items"] = f"""SELECT page_id, CAST(n - 1 AS INTEGER) AS pos, text FROM (
  SELECT page_id, len(items) AS size, unnest(items) AS text, generate_subscripts(items, 1) AS n FROM ({ITEMS}))
WHERE n >= 2 AND n <= size - 2"""
    q["extract_tail_text"] = sql(["bouts"], "SELECT bout_id AS page_id, 'Referee ' || bout_id % 13 AS text FROM bouts")
    q["bout_record_from_page"] = sql(["bouts"], """SELECT bout_id AS page_id, bout_date,
  'Hall & Dome ' || date_diff('day', DATE '1970-01-01', bout_date) % 9 AS location, r_name, b_name, winner, championship_fight, win_method, 'after ' || finish_time AS win_method_details,
  number_of_rounds, finish_round, finish_time, 'Referee ' || bout_id % 13 AS referee,
  (finish_round - 1) * 300 + finish_seconds AS total_fight_time FROM bouts""")
    q["corner_records_from_page"] = sql(["stats"],
        f"SELECT bout_id AS page_id, corner, {', '.join(STAT_COLUMNS)} FROM stats")
    q["skip_incomplete_quotes"] = sql(["quotes"],
        "SELECT quote_id AS page_id, left_odds, right_odds FROM quotes WHERE quote_id % 6 <> 0")

    q["quotes_from_page"] = sql(["quotes"], """SELECT quote_id AS page_id, left_name, right_name, left_odds, right_odds,
  quote_date, weight_class FROM quotes WHERE quote_id % 6 <> 0""")
    q["pages_without_quote"] = sql(["quotes"], "SELECT quote_id AS page_id FROM quotes WHERE quote_id % 6 = 0")
    days = "date_diff('day', DATE '1970-01-01', bout_date)"
    where = f"'Hall & Dome ' || {days} % 9"
    spelt = "CASE WHEN r_id % 4 = 0 THEN 'Women' || chr(39) || 's ' ELSE '' END || weight_class"
    short = "CASE WHEN r_id % 4 = 0 THEN split_part(lower(weight_class), ' ', 1) ELSE lower(weight_class) END"
    q["cards_from_page"] = sql(["bouts"], f"""SELECT DISTINCT 2000000 + {days} % 2 AS page_id,
  '/event/' || bout_date AS event_path, bout_date, {where} AS location FROM bouts""")
    in_event = "row_number() OVER (PARTITION BY bout_date ORDER BY bout_id)"
    q["event_rows_from_page"] = sql(["bouts"], f"""SELECT 1000000 + {days} AS page_id, CAST({in_event} AS INTEGER) AS pos,
  '/bout/' || bout_id AS bout_path, r_name, b_name, {short} AS weight_class, '/event/' || bout_date AS event_path FROM bouts""")
    q["bout_context"] = sql(["bouts"], f"""SELECT bout_id AS page_id, bout_date, {where} AS location,
  {short} AS weight_class, {pounds(short)} AS weight FROM bouts""")
    # The bout a competitor's page names first, and its title.
    first = f"""SELECT id, arg_min(r_id, bout_id) % 4 = 0 AS women, arg_min({spelt}, bout_id) || ' Bout' AS bout_class
FROM (SELECT r_id AS id, * FROM bouts UNION ALL SELECT b_id, * FROM bouts) GROUP BY id"""
    q["competitors_from_page"] = sql(["bouts", "raw"], """SELECT 3000000 + id AS page_id, name,
  CASE WHEN no_height THEN '--' ELSE (h // 12) || chr(39) || ' ' || h % 12 || '"' END AS height,
  CASE WHEN no_weight THEN '--' ELSE w || ' lbs.' END AS weight,
  CASE WHEN re IS NULL THEN '--' ELSE re || '"' END AS reach, coalesce(st, '') AS stance,
  strftime(dob, '%b %d, %Y') AS date_of_birth, bout_class FROM raw JOIN first USING (id) WHERE id % 23 <> 1""", {"first": first})
    q["competitors_without_bout"] = sql(["bouts", "raw"], """SELECT 3000000 + id AS page_id FROM raw JOIN first USING (id)
WHERE id % 23 = 1""", {"first": first})
    q["card_from_page"] = sql(["card"], f"""SELECT CAST(1 AS BIGINT) AS page_id,
  CAST(row_number() OVER (ORDER BY card_id) - 1 AS INTEGER) AS pos, r_name, b_name, {spelt} AS weight_class FROM card""")
    q["nested_cells"] = sql(["bouts"], f"""SELECT page_id, 0 AS pos, 0 AS level, CAST(NULL AS INTEGER) AS around, 'heading' AS text
  FROM (SELECT DISTINCT 1000000 + {days} AS page_id FROM bouts)
UNION ALL SELECT page_id, CAST(base + c.p AS INTEGER), c.l, CAST(CASE WHEN c.l = 1 THEN base + 2 END AS INTEGER), c.t FROM (
  SELECT page_id, base, unnest([{{'p': 0, 'l': 0, 't': 'win'}}, {{'p': 1, 'l': 0, 't': r_name || ' ' || b_name}},
    {{'p': 2, 'l': 0, 't': '12'}}, {{'p': 3, 'l': 1, 't': '1'}}, {{'p': 4, 'l': 1, 't': '2'}}, {{'p': 5, 'l': 0, 't': '3'}},
    {{'p': 6, 'l': 0, 't': '4'}}, {{'p': 7, 'l': 0, 't': '5'}}, {{'p': 8, 'l': 0, 't': {spelt}}}]) AS c
  FROM (SELECT *, 1000000 + {days} AS page_id, 1 + ({in_event} - 1) * 9 AS base FROM bouts))""")

    # standardisation
    nine = ", ".join(f"{c}_landed, {c}_attempted" for c in AREAS)
    q["parse_landed_attempted"] = sql(["stats"], f"SELECT stats_id, {nine} FROM stats")
    per_round = " UNION ALL ".join(
        f"SELECT stats_id, {n} AS round, round_{n}_sig_str_landed AS landed, round_{n}_sig_str_attempted AS attempted "
        f"FROM stats WHERE round_{n}_sig_str_attempted IS NOT NULL" for n in range(1, 6)
    )
    q["parse_round_cells"] = sql(["stats"], per_round)
    rounds = ", ".join(f"round_{n}_sig_str_{p}" for n in range(1, 6) for p in ("landed", "attempted"))
    q["pad_rounds"] = sql(["stats"], f"SELECT stats_id, {rounds} FROM stats")
    q["zero_fill_stats"] = sql(["stats"], "SELECT stats_id, "
        + ", ".join(f"coalesce({c}, 0) AS {c}" for c in STAT_COLUMNS) + " FROM stats")
    q["parse_clock"] = sql(["bouts"], "SELECT bout_id, finish_seconds AS seconds FROM bouts")
    q["bout_duration"] = sql(["bouts"],
        "SELECT bout_id, (finish_round - 1) * 300 + finish_seconds AS total_fight_time FROM bouts")
    q["parse_height"] = sql(["raw"], "SELECT id, CASE WHEN NOT no_height THEN h END AS height FROM raw")
    q["strip_unit"] = sql(["raw"], "SELECT id, CASE WHEN NOT no_weight THEN w END AS weight, re AS reach FROM raw")
    shown = """CASE WHEN NOT no_height THEN (h // 12) || ''' ' || (h % 12) || mark END AS height,
  CASE WHEN NOT no_weight THEN w || ' lbs.' END AS weight, re || mark AS reach, st AS stance"""
    q["sentinel_to_null"] = sql(["raw"], f"SELECT id, {shown} FROM raw")
    q["reach_from_height"] = sql(["competitors"], "SELECT id, height, coalesce(reach, height) AS reach FROM competitors")
    usable = "NOT no_height AND NOT no_weight AND st IS NOT NULL"
    q["require_attributes"] = sql(["raw"], f"SELECT id, name FROM raw WHERE {usable}")
    q["parse_dates"] = sql(["bouts"],
        "SELECT bout_id, bout_date AS card_day, bout_date AS birth_day, bout_date AS quote_day FROM bouts")
    q["weight_class_to_pounds"] = sql(["bouts"],
        f"SELECT bout_id, {pounds('lower(weight_class)')} AS weight, CAST(NULL AS INTEGER) AS unknown FROM bouts")
    q["gender_and_class"] = sql(["raw"], """SELECT id, gender,
  CASE WHEN gender = 'female' THEN split_part(lower(class_title), ' ', 1) ELSE lower(class_title) END AS class FROM raw""")
    q["parse_american_odds"] = sql(["quotes"], """SELECT quote_id, CAST(left_odds AS INTEGER) AS left_odds,
  CAST(right_odds AS INTEGER) AS right_odds, CAST(NULL AS INTEGER) AS no_odds FROM quotes""")
    q["fold_accents_and_hyphens"] = f"SELECT doc_id, {_plain('text')} AS text FROM documents"
    q["last_name_key"] = sql(["bouts"], "SELECT bout_id, CAST(r_id AS VARCHAR) AS last_name FROM bouts")
    odd = "CASE WHEN bout_id % 97 = 0 THEN NULL WHEN winner = '' THEN {} WHEN winner = r_name THEN {} ELSE {} END"
    q["result_to_label"] = sql(["bouts"], f"""SELECT bout_id, {odd.format("'DRAW'", "'Red'", "'Blue'")} AS winner_side,
  {odd.format(2, 0, 1)} AS label FROM bouts""")
    q["rejected_results"] = sql(["bouts"], "SELECT bout_id, 'nobody' AS winner FROM bouts WHERE bout_id % 97 = 0")
    q["clean_competitors"] = sql(["raw"], f"""SELECT id, name, h AS height, w AS weight, coalesce(re, h) AS reach,
  st AS stance, dob AS date_of_birth, gender FROM raw WHERE {usable}""")

    # projections and filters
    q["bouts_without_ids"] = sql(["unresolved"], "SELECT bout_id, r_name, b_name FROM unresolved WHERE r_id IS NULL")
    q["bouts_without_odds"] = sql(["unresolved"],
        "SELECT bout_id, r_name, b_name, bout_date FROM unresolved WHERE quote_id IS NULL")
    q["bouts_of_competitor"] = sql(["linked_sides", "card"], f"""SELECT * FROM linked_sides
WHERE totals_id IS NOT NULL AND bout_date < {DAY}
  AND competitor_id IN (SELECT r_id FROM card UNION SELECT b_id FROM card)""")
    plain = []
    for c in CORNER_FEATURES:
        if c == "age":
            text = "CAST(e.bout_date - c.date_of_birth AS INTEGER)"
        elif c == "reach":
            text = "coalesce(c.reach, c.height)"
        else:
            text = f"c.{c}" if c in _BODY else f"e.{c}"
        plain.append(f"{text} AS r_{c}")
    q["project_features"] = sql(["entering", "competitors"], f"""SELECT e.bout_id, {', '.join(plain)}
FROM entering e JOIN competitors c ON c.id = e.competitor_id WHERE corner = 'r'""")
    blue = [c.replace(" AS r_", " AS b_") for c in plain]
    q["project_features_blue"] = sql(["entering", "competitors"], f"""SELECT e.bout_id, {', '.join(blue)}
FROM entering e JOIN competitors c ON c.id = e.competitor_id WHERE corner = 'b'""")
    shown = "SELECT bout_id, win_method, winner, r_odds, b_odds, r_wins, b_losses FROM dataset"
    q["no_draws"] = sql(["dataset"], f"{shown} WHERE winner <> 'DRAW'")
    q["no_overturned"] = sql(["dataset"], f"{shown} WHERE win_method <> 'Overturned'")
    q["with_odds"] = sql(["dataset"], f"{shown} WHERE bout_id % 11 <> 0")
    q["all_bouts"] = sql(["dataset"], shown)

    # joins
    q["resolve_names"] = sql(["unresolved", "competitors"], """SELECT bout_id, r_name, b_name, r.id AS r_id, b.id AS b_id
FROM (SELECT bout_id, r_name, b_name FROM unresolved) u
LEFT JOIN competitors r ON r.name = u.r_name LEFT JOIN competitors b ON b.name = u.b_name""")
    q["resolve_aliases"] = sql(["resolved"], "SELECT quote_id, left_name, right_name FROM resolved")
    q["match_quotes"] = sql(["matched"], "SELECT quote_id, bout_id FROM matched")
    q["orient_quotes"] = sql(["oriented"], "SELECT quote_id, bout_id, r_odds, b_odds, weight_class FROM oriented")
    q["unmatched_quotes"] = sql(["resolved", "matched"], """SELECT quote_id, left_name, right_name, quote_date
FROM resolved WHERE quote_id NOT IN (SELECT quote_id FROM matched)""")
    q["previous_bout"] = sql(["sides", "linked"], """SELECT p.event_id AS probe_id, p.user_id AS competitor_id, p.ts AS probe_ts,
  s.bout_ts AS previous_ts, s.bout_id AS previous_bout_id, s.corner AS previous_corner
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT s.* FROM sides s JOIN linked l USING (bout_id)
  WHERE l.r_totals_id IS NOT NULL AND l.b_totals_id IS NOT NULL) s
  ON s.competitor_id = p.user_id AND s.bout_ts < p.ts""")
    q["previous_totals"] = sql(["entering"],
        f"SELECT {CORNER}, wins, losses, opponent_wins, sig_str_landed, fight_time FROM entering")
    q["matchup_join"] = sql(["matchups"], "SELECT * EXCLUDE (weight) FROM matchups")
    pair = """FROM card c LEFT JOIN early r ON r.competitor_id = c.r_id LEFT JOIN early b ON b.competitor_id = c.b_id"""
    q["predictable_only"] = sql(["card", "early"], f"""SELECT card_id, r.totals_id AS r_totals_id, b.totals_id AS b_totals_id
{pair} WHERE r.totals_id IS NOT NULL AND b.totals_id IS NOT NULL""")
    q["not_predictable"] = sql(["card", "early"],
        f"SELECT card_id, r_name, b_name {pair} WHERE r.totals_id IS NULL OR b.totals_id IS NULL")
    q["same_name_semi"] = """SELECT p_partkey, p_name FROM part WHERE p_name IN (
  SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 2)"""
    q["dedupe_anti"] = """SELECT p_partkey, p_name FROM part
WHERE p_name = 'red plate' OR p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_name)"""
    q["name_search_ci"] = sql(["competitors", "unresolved"], """SELECT id AS entry_id, 'User' AS first_name,
  CAST(id AS VARCHAR) AS last_name FROM competitors
WHERE lower(name) IN (SELECT lower(r_name) FROM unresolved WHERE r_id IS NULL)""")
    three = ["sig_str_landed", "kd_landed", "ctrl_time"]
    q["opponent_mirror"] = sql(["stats"], "SELECT s.bout_id, s.corner, s.competitor_id, "
        "o.competitor_id AS opponent_competitor_id, " + ", ".join(f"s.{c}, o.{c} AS opponent_{c}" for c in three)
        + " FROM stats s JOIN stats o ON o.bout_id = s.bout_id AND o.corner <> s.corner")

    # aggregations
    q["duplicate_names"] = "SELECT p_name, count(*) AS copies FROM part GROUP BY p_name HAVING count(*) >= 2"
    q["min_id_per_name"] = "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name"
    q["last_bout_date"] = sql(["linked_sides"], f"""SELECT competitor_id, max(bout_date) AS last_date FROM linked_sides
WHERE totals_id IS NOT NULL AND bout_date < {DAY} GROUP BY competitor_id""")
    q["missing_names"] = sql(["unresolved"], "SELECT DISTINCT r_name AS name FROM unresolved WHERE r_id IS NULL")
    q["value_counts"] = sql(["labels_of"], "SELECT winner, count(*) AS n FROM labels_of GROUP BY winner")
    q["column_mean_std"] = sql(["dataset"], _mean_std(), {"train": f"SELECT * FROM dataset WHERE NOT ({HASHED})"})
    q["latest_totals"] = sql(["totals"], f"""SELECT totals_id, {CORNER}, wins, losses, draws FROM totals
WHERE totals_id IN (SELECT max(totals_id) FROM totals GROUP BY competitor_id)""")

    # running totals
    running = {
        "running_strikes": STRIKES, "running_record": RECORD,
        "running_opponent_record": ["opponent_wins", "opponent_loses"],
        "running_control": ["ctrl_time", "opponent_ctrl_time"],
        "running_knockdowns": ["kd_landed", "kd_absorbed"],
        "running_submissions": ["subs_attempted", "subs_evaded"],
        "running_fight_time": ["fight_time", "opponent_fight_time"],
        "running_reversals": ["reversals"], "championship_count": ["championship_fights"],
        "split_hot_totals": RECORD + ["opponent_wins", "opponent_fight_time", "sig_str_evaded"],
    }
    for name, columns in running.items():
        q[name] = sql(["totals"], f"SELECT {CORNER}, {', '.join(columns)} FROM totals")
    q["age_at_bout"] = sql(["sides", "competitors"], f"""SELECT {CORNER},
  CAST(bout_date - date_of_birth AS INTEGER) AS age FROM sides JOIN competitors c ON c.id = competitor_id""")
    every = ", ".join(TOTAL_COLUMNS)
    q["cumulative_totals"] = sql(["totals", "competitors"], f"""SELECT {CORNER}, c.name,
  CAST(bout_date - date_of_birth AS INTEGER) AS age, {every} FROM totals JOIN competitors c ON c.id = competitor_id""")
    q["pre_bout_totals"] = sql(["entering"], f"SELECT {CORNER}, {every} FROM entering")
    q["late_bouts_totals"] = sql(["totals"], f"SELECT {CORNER}, {every} FROM totals")
    q["late_bouts_totals_cut"] = q["late_bouts_totals"]
    q["late_bouts_corrections"] = sql(["totals", "legs"], f"""SELECT t.totals_id, {every} FROM totals t
        JOIN late_reach r USING (totals_id) WHERE r.reached AND t.bout_id % 10 <> 0""", {
        "late_before": f"SELECT *, sum(CAST(bout_id % 10 = 0 AS INT)) {UP_TO} AS late FROM legs",
        "late_reach": f"""SELECT l.bout_id * 2 + CASE l.corner WHEN 'r' THEN 0 ELSE 1 END AS totals_id,
            bool_or(l.late > 0 OR o.late > 0) OVER (PARTITION BY l.competitor_id ORDER BY l.bout_ts, l.bout_id
            ROWS UNBOUNDED PRECEDING) AS reached
            FROM late_before l JOIN late_before o ON o.bout_id = l.bout_id AND o.corner <> l.corner""",
    })
    q["incremental_totals"] = sql(["totals"], f"SELECT {CORNER}, {every} FROM totals WHERE bout_date > {DAY}")

    # sorts and top-k
    q["bouts_by_date"] = sql(["bouts"], "SELECT bout_id, bout_date, r_id, b_id FROM bouts ORDER BY bout_date, bout_id")
    q["latest_one"] = sql(["totals"], f"""SELECT totals_id, {CORNER}, wins, losses, draws FROM totals
WHERE competitor_id = 7 ORDER BY totals_id DESC LIMIT 1""")

    # features
    dummies = [
        f"CAST(coalesce({c} = '{v}', FALSE) AS INTEGER) AS {c}_{v.replace(' ', '_')}"
        for c in VOCABULARY for v in VOCABULARY[c]
    ]
    q["one_hot"] = sql(["dataset"], f"SELECT bout_id, {', '.join(dummies)} FROM dataset")
    q["align_dummies"] = sql(["competitors"],
        "SELECT id, CASE WHEN gender = 'female' THEN 1 ELSE 0 END AS gender_female, 0 AS gender_male FROM competitors")
    q["encode_label"] = sql(["labels_of"],
        "SELECT bout_id, CASE winner WHEN 'Red' THEN 0 WHEN 'Blue' THEN 1 ELSE 2 END AS label FROM labels_of")
    q["split_ordered"] = sql(["bouts"], """SELECT bout_id, CASE WHEN bout_date <= (SELECT min(bout_date) FROM (
    SELECT bout_date, sum(count(*)) OVER (ORDER BY bout_date) AS s, sum(count(*)) OVER () AS t FROM bouts GROUP BY bout_date)
    WHERE s >= 0.8 * t) THEN 'train' ELSE 'test' END AS split FROM bouts""")
    q["split_random"] = sql(["bouts"],
        f"SELECT bout_id, CASE WHEN {HASHED} THEN 'test' ELSE 'train' END AS split FROM bouts")
    five = ["r_wins", "b_losses", "r_age", "weight", "b_sig_str_landed"]
    scaled = ", ".join(
        f"round((d.{c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train), 6) AS {c}" for c in five
    )
    q["standardize"] = sql(["dataset"], f"SELECT d.bout_id, {scaled} FROM dataset d",
                                   {"train": f"SELECT * FROM dataset WHERE NOT ({HASHED})"})
    q["training_dataset"] = sql(["dataset"], "SELECT * FROM dataset")
    q["training_dataset_after"] = sql(["bouts", "totals"], """SELECT r.bout_id, r.wins AS r_wins, b.wins AS b_wins,
  r.td_evaded AS r_td_evaded, b.opponent_fight_time AS b_opponent_fight_time
FROM totals r JOIN totals b ON b.bout_id = r.bout_id AND b.corner = 'b' WHERE r.corner = 'r'""")
    q["upcoming_features"] = sql(["matchups"], f"""SELECT card_id, r_name, b_name,
  CASE WHEN r_id % 4 = 0 THEN {pounds("split_part(lower(weight_class), ' ', 1)")} ELSE weight END AS weight,
  {', '.join(c for c in FEATURES if c != 'weight')}
FROM matchups JOIN (SELECT card_id, weight_class FROM card) USING (card_id)
WHERE r_totals_id IS NOT NULL AND b_totals_id IS NOT NULL""")
    q["card_page_features"] = f"""SELECT r_name, b_name, weight, gender, r_age, b_stance, r_wins, b_opponent_wins, b_fight_time
  FROM ({q['upcoming_features']}) u"""
    unknown = " OR ".join(f"{c} IS NULL" for c in NUMERIC_FEATURES)
    q["predict_upcoming_rejects"] = (
        f"SELECT card_id, r_name, b_name FROM ({q['upcoming_features']}) u WHERE {unknown}"
    )

    # What holds for every model's scores of the test rows.
    tested = f"""SELECT bout_id, CAST(CASE winner WHEN 'Red' THEN 0 WHEN 'Blue' THEN 1 ELSE 2 END AS INTEGER) AS label
  FROM dataset WHERE winner IS NOT NULL AND NOT ({unknown}) AND {HASHED}"""
    q["scored_rows"] = sql(["dataset"], """SELECT model, bout_id, label, TRUE AS adds_up, TRUE AS largest
  FROM tested, (SELECT unnest(['gbt', 'softmax', 'forest', 'mlp', 'network']) AS model)
  WHERE label < 2 OR model IN ('softmax', 'forest')""", {"tested": tested})
    q["saved_scores"] = sql(["dataset"], "SELECT bout_id, TRUE AS same FROM tested", {"tested": tested})

    # evaluation
    q["accuracy"] = sql(["predicted"], """SELECT split, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6)
  AS accuracy FROM predicted GROUP BY split""")
    guesses = ", ".join(f"count(*) FILTER (prediction = {c}) AS predicted_{c}" for c in range(3))
    q["confusion_matrix"] = sql(["predicted"], f"SELECT label, {guesses} FROM predicted GROUP BY label")
    q["classification_report"] = sql(["predicted"], """
SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM per
UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS a,
  count(*) AS n FROM predicted)
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6),
  CAST(sum(s) AS BIGINT) FROM per""", {"per": """
SELECT c, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, s FROM (
  SELECT c, coalesce(t / nullif(CAST(g AS DOUBLE), 0), 0) AS p, coalesce(t / nullif(CAST(s AS DOUBLE), 0), 0) AS r, s FROM (
    SELECT c, count(*) FILTER (label = c AND prediction = c) AS t, count(*) FILTER (prediction = c) AS g,
      count(*) FILTER (label = c) AS s
    FROM predicted JOIN (SELECT unnest([0, 1, 2]) AS c) k ON TRUE GROUP BY c))"""})
    q["betting_units"] = sql(["won"], """SELECT round(sum(units), 6) AS units, count(*) FILTER (label = prediction) AS correct,
  count(*) FILTER (label <> prediction) AS incorrect FROM won""")
    q["bet_per_bout"] = sql(["won"], "SELECT bout_id, round(CAST(units AS DOUBLE), 6) AS units FROM won")
    q["correct_incorrect"] = sql(["predicted"], """SELECT count(*) FILTER (label = prediction) AS correct,
  count(*) FILTER (label <> prediction) AS incorrect FROM predicted""")

    # what no model can learn from or place
    q["labelled_rejects"] = sql(["dataset"], f"SELECT bout_id, winner FROM dataset WHERE winner IS NULL OR {unknown}")

    q["unlabelled_rows"] = sql(["dataset"], f"""SELECT bout_id, winner FROM dataset
  WHERE winner IS NULL OR {unknown} OR bout_id % 9 = 0""")

    # refreshes
    done, waiting = f"(x.bout_date <= {DAY} OR x.bout_id % 13 = 0)", f"(x.bout_date > {DAY} AND x.bout_id % 13 <> 0)"
    last = f"(SELECT max(bout_id * 2 + CASE corner WHEN 'r' THEN 0 ELSE 1 END) FROM sides WHERE {done.replace('x.', '')})"
    number = "row_number() OVER (ORDER BY {0}bout_ts, {0}bout_id, {0}corner DESC)"
    q["refresh_totals"] = _increment_sql(TOTAL_COLUMNS, done, waiting, f"""
SELECT {last} + {number.format('g.')} AS totals_id, g.bout_id, g.corner, g.competitor_id,
  CAST(g.bout_date - c.date_of_birth AS INTEGER) AS age, {', '.join('g.' + c for c in TOTAL_COLUMNS)}
FROM grown g JOIN competitors c ON c.id = g.competitor_id""")
    # Late bouts take ids behind the greatest stored one, in order of their moment.
    numbered = {"numbered": """SELECT t.*, CASE WHEN bout_id % 10 <> 0 THEN totals_id ELSE
        max(CASE WHEN bout_id % 10 <> 0 THEN totals_id END) OVER ()
        + row_number() OVER (PARTITION BY bout_id % 10 = 0 ORDER BY bout_ts, bout_id, corner DESC) END AS new_id
        FROM totals t"""}
    q["refresh_late_totals"] = sql(["totals", "competitors"], f"""SELECT new_id AS totals_id, {CORNER}, c.name,
        CAST(t.bout_date - c.date_of_birth AS INTEGER) AS age, {every} FROM numbered t
        JOIN competitors c ON c.id = competitor_id""", numbered)
    q["refresh_late_totals_links"] = sql(["totals", "bouts"], """SELECT b.bout_id,
        max(CASE WHEN corner = 'r' THEN new_id END) AS r_totals_id,
        max(CASE WHEN corner = 'b' THEN new_id END) AS b_totals_id
        FROM bouts b LEFT JOIN numbered n USING (bout_id) GROUP BY b.bout_id""", numbered)
    q["refresh_totals_links"] = sql(["sides", "pending_sides", "linked"], f"""
SELECT l.bout_id, coalesce(l.r_totals_id, r.t) AS r_totals_id, coalesce(l.b_totals_id, b.t) AS b_totals_id
FROM linked l LEFT JOIN numbered r ON r.bout_id = l.bout_id AND r.corner = 'r'
LEFT JOIN numbered b ON b.bout_id = l.bout_id AND b.corner = 'b'""",
        {"numbered": f"SELECT bout_id, corner, {last} + {number.format('')} AS t FROM pending_sides"})
    pending_odds = {
        "fresh": f"SELECT * FROM oriented WHERE quote_id IN (SELECT quote_id FROM quotes WHERE quote_date > {DAY} AND bout_id IS NULL)",
        "top": "SELECT * FROM fresh f WHERE quote_id = (SELECT max(g.quote_id) FROM fresh g WHERE g.bout_id = f.bout_id)",
    }
    q["refresh_odds"] = sql(["bouts", "oriented"], f"""SELECT b.bout_id, n.quote_id, n.r_odds, n.b_odds,
  {pounds('lower(n.weight_class)')} AS weight FROM bouts b LEFT JOIN top n ON n.bout_id = b.bout_id""", pending_odds)
    q["refresh_odds_unmatched"] = sql(["resolved", "matched"], f"""SELECT quote_id, left_name, right_name, quote_date
FROM resolved WHERE quote_date > {DAY} AND bout_id IS NULL AND quote_id NOT IN (SELECT quote_id FROM matched)""")
    people = {
        # Bouts whose event page names them.
        "late": f"SELECT * FROM bouts WHERE bout_date > {DAY} AND bout_id % 10 <> 3",
        "first": first,
        "known": "SELECT id, name FROM competitors WHERE id % 7 <> 0",
        "added": f"""SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY substr(md5(name), 1, 8), name) AS id,
  name, w AS weight, coalesce(re, h) AS reach, st AS stance, CASE WHEN women THEN 'female' ELSE 'male' END AS gender
  FROM raw JOIN first USING (id) WHERE {usable} AND id % 7 = 0 AND id % 23 <> 1
  AND name IN (SELECT r_name FROM late UNION SELECT b_name FROM late)""",
        "everyone": "SELECT id, name FROM known UNION ALL SELECT id, name FROM added",
        "numbered": f"""SELECT l.*, (SELECT max(bout_id) FROM bouts WHERE bout_date <= {DAY})
  + row_number() OVER (ORDER BY bout_date, bout_id) AS new_id FROM late l""",
    }
    last_stats = f"(SELECT max(bout_id) * 2 + 1 FROM bouts WHERE bout_date <= {DAY})"
    place = f"(n.new_id - (SELECT max(bout_id) FROM bouts WHERE bout_date <= {DAY}))"
    ids = {side: f"{last_stats} + {place} * 2 - {back}" for side, back in (("r", 1), ("b", 0))}
    q["refresh_bouts"] = sql(["bouts", "raw"], f"""SELECT n.new_id AS bout_id, bout_date, {where} AS location,
  {pounds(short.replace('r_id', 'rid'))} AS weight, r_name, b_name, winner, r.id AS r_id, b.id AS b_id,
  (finish_round - 1) * 300 + finish_seconds AS total_fight_time, {ids['r']} AS r_stats_id, {ids['b']} AS b_stats_id
FROM (SELECT * EXCLUDE (r_id, b_id), r_id AS rid FROM numbered) n
LEFT JOIN everyone r ON r.name = n.r_name LEFT JOIN everyone b ON b.name = n.b_name""", people)
    corner_id = f"CASE s.corner WHEN 'r' THEN {ids['r']} ELSE {ids['b']} END AS stats_id"
    corners = """FROM numbered n JOIN stats s ON s.bout_id = n.bout_id
LEFT JOIN everyone e ON e.name = 'user ' || s.competitor_id"""
    q["refresh_bouts_stats"] = sql(["bouts", "raw", "stats"], f"""SELECT n.new_id AS bout_id, s.corner, e.id AS competitor_id,
  {corner_id}, {', '.join('s.' + c for c in STAT_COLUMNS)} {corners}""", people)
    q["refresh_bouts_lookup"] = sql(["bouts", "raw", "stats"], f"""SELECT n.new_id AS bout_id, {corner_id}, s.corner,
  e.id AS competitor_id, s.kd_landed {corners}""", people)
    q["refresh_bouts_unplaced"] = sql(["bouts"], f"SELECT bout_id AS page_id FROM bouts WHERE bout_date > {DAY} AND bout_id % 10 = 3")
    q["refresh_quotes"] = sql(["quotes"], f"""SELECT (SELECT max(quote_id) FROM quotes WHERE quote_date <= {DAY})
  + row_number() OVER (ORDER BY quote_date, quote_id) AS quote_id, quote_id AS page_id, left_name, right_name, left_odds,
  right_odds, quote_date, weight_class FROM quotes WHERE quote_date > {DAY} AND quote_id % 6 <> 0""")
    q["refresh_bouts_competitors"] = sql(["bouts", "raw"], "SELECT id, name, weight, reach, stance, gender FROM added", people)
    return q
