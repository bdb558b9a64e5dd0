"""DuckDB SQL for every catalogued query: the independent oracle of the Spark plans.

Each text is self-contained: a ``WITH`` prefix rebuilds the surrogate views (annotations, gold, runs, cohorts, …)
from the driver tables, then the query follows. These texts are written from the operator definitions, not
generated from the Spark code."""

from __future__ import annotations

from replyscope.functions import fixed
from replyscope.sources import fixtures as fx

# ------------------------------------------------------------------------------------------------ views

V: dict[str, str] = {}

V["annotations"] = fx.ANNOTATIONS_SQL

V["cohorts"] = """
SELECT user_id, cohort FROM (
  SELECT user_id, unnest([CASE WHEN user_id % 5 = 0 THEN 'western' END,
                          CASE WHEN user_id % 7 = 3 THEN 'african' END,
                          CASE WHEN user_id % 3 = 1 THEN 'student' END]) AS cohort
  FROM (SELECT DISTINCT user_id FROM annotations WHERE user_id IS NOT NULL)
) WHERE cohort IS NOT NULL
"""

V["labeled"] = """
SELECT a.*,
  CASE WHEN contains(a.nat_lang, 'en') THEN 'native' ELSE 'non_native' END AS native_or_not,
  CASE WHEN a.nat_lang = '{en}' THEN 'strict native' ELSE 'not strict native' END AS strict_native_or_not,
  CASE WHEN a.user_id IN (SELECT user_id FROM cohorts WHERE cohort = 'western') THEN 'western native'
       ELSE 'not western native' END AS western_native_or_not,
  CASE WHEN a.user_id IN (SELECT user_id FROM cohorts WHERE cohort = 'african') THEN 'african'
       ELSE 'not african' END AS african_or_not,
  CASE WHEN a.user_id IN (SELECT user_id FROM cohorts WHERE cohort = 'student') THEN 'student'
       ELSE 'not student' END AS student_or_not
FROM annotations a
"""

V["gold"] = """
SELECT nat_instr_id, arg_min(req_output, row_id) AS generated_req_output
FROM annotations WHERE nat_instr_id IS NOT NULL GROUP BY nat_instr_id
"""

V["runs"] = """
SELECT row_id, dataset_id, set_id, example_id, nat_instr_id, user_id, nat_lang, validated, task_def, instruction,
       prompt_en, req_output, 'model_a' AS model, mode,
       CASE WHEN mode = 'add_all_native' AND row_id % 3 = 0 THEN req_output
            WHEN mode = 'add_all_non_native' AND row_id % 4 = 1 THEN req_output
            WHEN mode = 'guess_native' AND row_id % 5 = 2 THEN req_output
            ELSE reply END AS reply,
       CASE WHEN mode = 'guess_native' THEN
            (['a native one', 'a non-native writer', 'non-native, not a native', 'unclear'])[row_id % 4 + 1]
       END AS side_output
FROM (SELECT *, unnest(['standard', 'add_all_native', 'add_all_non_native', 'guess_native']) AS mode
      FROM annotations)
"""

V["runs_labeled"] = """
SELECT r.*,
  CASE WHEN contains(r.nat_lang, 'en') THEN 'native' ELSE 'non_native' END AS native_or_not
FROM runs r
"""


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({V[n]})" for n in names) + "\n"


# ------------------------------------------------------------------------------------------------ expressions


def digit_sum(x: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '(\\d+)', 1), lambda d: d::DECIMAL(38,0))), 0)"


def accuracy(reply: str = "reply", gold: str = "req_output", ds: str = "dataset_id") -> str:
    r, g = reply, gold
    letters = f"(CAST(contains({r}, 'A') AS INT) + CAST(contains({r}, 'B') AS INT) + CAST(contains({r}, 'C') AS INT))"
    marked = (
        f"(CAST(contains({r}, 'A.') OR contains({r}, 'A:') AS INT) + CAST(contains({r}, 'B.') OR contains({r}, 'B:') AS INT)"
        f" + CAST(contains({r}, 'C.') OR contains({r}, 'C:') AS INT))"
    )
    return f"""CAST(CASE WHEN {r} IS NULL THEN NULL
  WHEN {ds} = 3 THEN CASE WHEN NOT regexp_matches({g}, '^\\s*[+-]?\\d+\\s*$') THEN NULL
                          ELSE CAST({digit_sum(r)} = CAST(trim({g}) AS DECIMAL(38,0)) AS INT) END
  WHEN {ds} IN (0, 2) THEN CASE WHEN regexp_extract({g}, '(\\d)', 1) = '' THEN NULL
                          ELSE CAST({digit_sum(r)} = CAST(regexp_extract({g}, '(\\d)', 1) AS DECIMAL(38,0)) AS INT) END
  WHEN {ds} IN (4, 5) THEN CASE WHEN contains(lower({r}), 'no') AND contains(lower({r}), 'yes') THEN NULL
                          ELSE CAST(contains(lower({r}), replace(lower({g}), '.', '')) AS INT) END
  WHEN {ds} = 9 THEN CASE WHEN {letters} = 1 OR {marked} = 1 THEN CAST(contains({r}, {g}) AS INT) END
  END AS DOUBLE)"""


def guess_label(x: str) -> str:
    return f"""CASE WHEN contains({x}, 'native') AND NOT contains({x}, 'non-native') THEN 'native'
  WHEN contains({x}, 'non-native') AND NOT contains({x}, ' native') THEN 'non_native' ELSE 'unknown' END"""


# ------------------------------------------------------------------------------------------------ queries

SQL: dict[str, str] = {}

SQL["cohort_labels"] = with_views("annotations", "cohorts", "labeled") + """
SELECT row_id, user_id, nat_lang, native_or_not, strict_native_or_not, western_native_or_not, african_or_not,
       student_or_not FROM labeled
"""

SQL["cohort_membership_join"] = with_views("annotations", "cohorts") + """
SELECT row_id, user_id FROM annotations WHERE user_id IN (SELECT user_id FROM cohorts WHERE cohort = 'student')
"""

SQL["accuracy_all"] = with_views("annotations") + f"""
SELECT row_id, dataset_id, reply, req_output, {accuracy()} AS accuracy FROM annotations
"""

for _name, _ids in (("ratings", "3"), ("options", "0, 2"), ("yesno", "4, 5"), ("choice", "9")):
    SQL[f"accuracy_{_name}"] = with_views("annotations") + f"""
SELECT row_id, dataset_id, reply, req_output, {accuracy()} AS accuracy FROM annotations WHERE dataset_id IN ({_ids})
"""


def _macro(by: str = "", where: str = "") -> str:
    by_cols = f", {by}" if by else ""
    return with_views("annotations", "cohorts", "labeled") + f"""
, scored AS (SELECT *, {accuracy()} AS accuracy FROM labeled WHERE validated = 1 {where}),
long AS (
  SELECT 'native_or_not' AS cohort_type, native_or_not AS cohort, example_id{by_cols}, accuracy FROM scored
  UNION ALL SELECT 'strict_native_or_not', strict_native_or_not, example_id{by_cols}, accuracy FROM scored
  UNION ALL SELECT 'western_native_or_not', western_native_or_not, example_id{by_cols}, accuracy FROM scored
),
per_example AS (
  SELECT cohort_type, cohort{by_cols}, example_id, avg(accuracy) AS accuracy FROM long
  WHERE example_id IS NOT NULL {''.join(f' AND {b.strip()} IS NOT NULL' for b in by.split(',') if b.strip())}
  GROUP BY cohort_type, cohort{by_cols}, example_id
)
SELECT cohort_type, cohort{by_cols}, avg(accuracy) AS accuracy FROM per_example GROUP BY cohort_type, cohort{by_cols}
"""


SQL["macro_accuracy_overall"] = _macro()
SQL["macro_accuracy_set"] = _macro("set_id")
SQL["macro_accuracy_dataset"] = _macro("dataset_id")
SQL["macro_accuracy_sets"] = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (
    f"SELECT 'overall' AS level, *, CAST(NULL AS INT) AS set_id, CAST(NULL AS INT) AS dataset_id FROM ({_macro()})",
    f"SELECT 'set_id', cohort_type, cohort, accuracy, set_id, NULL FROM ({_macro('set_id')})",
    f"SELECT 'dataset_id', cohort_type, cohort, accuracy, NULL, dataset_id FROM ({_macro('dataset_id')})"))
SQL["no3"] = _macro(where="AND dataset_id IS DISTINCT FROM 3")

SQL["guess_labels"] = with_views("annotations", "runs") + f"""
SELECT row_id, side_output, {guess_label('side_output')} AS final_guess FROM runs WHERE mode = 'guess_native'
"""

SQL["guess_counts"] = with_views("annotations", "runs", "runs_labeled") + f"""
, g AS (SELECT *, {guess_label('side_output')} = native_or_not AS correct FROM runs_labeled WHERE mode = 'guess_native')
SELECT model, count(*) AS n_rows, CAST(count_if(native_or_not = 'native') AS BIGINT) AS n_native,
       CAST(count_if(correct AND native_or_not = 'native') AS BIGINT) AS n_correct_native,
       CAST(count_if(correct AND native_or_not = 'non_native') AS BIGINT) AS n_correct_non_native
FROM g GROUP BY model
"""


# ------------------------------------------------------------------------------------------------ helpers (SQL text)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill(template: str, prompt: str) -> str:
    out = template
    for form in fixed.PLACEHOLDER_FORMS:
        out = f"replace({out}, {lit(form)}, {prompt})"
    return out


def strip_tags(x: str) -> str:
    return f"replace(replace({x}, {lit(fixed.TAG_CLOSE)}, ''), {lit(fixed.TAG_OPEN)}, '')"


def task_def(td: str = "task_def", ds: str = "dataset_id") -> str:
    cases = " ".join(f"WHEN {k} THEN {td} || {lit(v)}" for k, v in fixed.TASK_SUFFIX.items())
    return f"(CASE {ds} {cases} ELSE {td} END)"


def temperature(ds: str = "dataset_id") -> str:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in fixed.TEMPERATURE.items())
    return f"CAST(CASE {ds} {cases} END AS DOUBLE)"


WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> ''))"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def echo(x: str) -> str:
    """SQL twin of the stub model's reply for a last user turn x."""
    y = f"coalesce({x}, '')"
    return f"(CAST(length({y}) % 5 + 1 AS VARCHAR) || ' echo ' || CAST(length({y}) AS VARCHAR) || ': ' || {y})"


def md5_60(key: str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 15)) AS BIGINT)"


def floyd(m: str, n: int, seed, row: str) -> list[str]:
    chosen: list[str] = []
    for i in range(n):
        j = f"({m} - {n} + {i})"
        t = f"({md5_60(lit(f'{seed}:') + f' || CAST({row} AS VARCHAR) || ' + lit(f':{i}'))} % ({j} + 1))"
        c = f"(CASE WHEN {t} IN ({', '.join(chosen)}) THEN {j} ELSE {t} END)" if chosen else t
        chosen.append(c)
    return chosen


def chat_rows(source: str, turns, keys=("row_id", "temperature"), where: str = "TRUE") -> str:
    parts = []
    for i, (role, content) in enumerate(turns):
        parts.append(f"SELECT {', '.join(keys)}, {i} AS turn, {lit(role)} AS role, {content} AS content FROM {source} WHERE {where}")
    return "\nUNION ALL ".join(parts)


def cohort_rules(table: str) -> str:
    return f"""
SELECT user_id, cohort FROM (
  SELECT user_id, unnest([CASE WHEN user_id % 5 = 0 THEN 'western' END,
                          CASE WHEN user_id % 7 = 3 THEN 'african' END,
                          CASE WHEN user_id % 3 = 1 THEN 'student' END]) AS cohort
  FROM (SELECT DISTINCT user_id FROM {table} WHERE user_id IS NOT NULL)
) WHERE cohort IS NOT NULL"""


def membership(alias: str, cohorts: str) -> str:
    return f"""CASE WHEN {alias}.user_id IN (SELECT user_id FROM {cohorts} WHERE cohort = 'western') THEN 'western native'
       ELSE 'not western native' END AS western_native_or_not,
  CASE WHEN {alias}.user_id IN (SELECT user_id FROM {cohorts} WHERE cohort = 'african') THEN 'african'
       ELSE 'not african' END AS african_or_not,
  CASE WHEN {alias}.user_id IN (SELECT user_id FROM {cohorts} WHERE cohort = 'student') THEN 'student'
       ELSE 'not student' END AS student_or_not"""


def unpivot(source: str, cohorts, cols: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {lit(c)} AS cohort_type, {c} AS cohort, {cols} FROM {source}" for c in cohorts
    )


STATS4 = ("native_or_not", "strict_native_or_not", "western_native_or_not", "african_or_not")
EVENT4 = ("native_or_not", "strict_native_or_not", "western_native_or_not", "african_or_not")

# ------------------------------------------------------------------------------------------------ text queries

SQL["placeholder_fill"] = with_views("annotations") + f"""
SELECT row_id, instruction, prompt_en, {fill('instruction', 'prompt_en')} AS final_prompt_en FROM annotations
"""

SQL["strip_tags"] = with_views("annotations") + f"SELECT row_id, {strip_tags('instruction')} AS stripped FROM annotations"

_PAIR = """CASE WHEN row_id % 3 = 0 THEN '(''' || prompt_en || ''', ''' || reply || ''')'
  WHEN row_id % 3 = 1 THEN '("' || prompt_en || '", "' || reply || '")'
  ELSE reply END"""

SQL["unwrap_pair"] = with_views("annotations") + f"""
SELECT row_id, pair,
  CASE WHEN contains(pair, ', ''') THEN replace(string_split(pair, ', ''')[2], ''')', '')
       WHEN contains(pair, ', "') THEN replace(string_split(pair, ', "')[2], '")', '')
       ELSE pair END AS unwrapped
FROM (SELECT row_id, {_PAIR} AS pair FROM annotations)
"""

SQL["digit_sum"] = with_views("annotations") + f"""
SELECT row_id, dataset_id, CAST({digit_sum('reply')} AS VARCHAR) AS reply_digit_sum,
  CAST({digit_sum('prompt_en')} AS VARCHAR) AS prompt_digit_sum,
  CASE WHEN dataset_id = 3 THEN CAST({digit_sum('reply')} AS VARCHAR) END AS predicted_rating
FROM annotations
"""

SQL["word_count_by_group"] = with_views("annotations", "cohorts", "labeled") + f"""
, w AS (SELECT *, {word_count('prompt_en')} AS wp, {word_count('reply')} AS wr FROM labeled),
long AS ({unpivot('w', STATS4, 'dataset_id, wp, wr')})
SELECT cohort_type, cohort, dataset_id, avg(wp) AS avg_words_prompt, avg(wr) AS avg_words_reply
FROM long WHERE cohort IS NOT NULL AND dataset_id IS NOT NULL GROUP BY cohort_type, cohort, dataset_id
"""

SQL["task_suffix"] = with_views("annotations") + f"SELECT row_id, dataset_id, {task_def()} AS task_definition FROM annotations"

SQL["temperature"] = with_views("annotations") + f"SELECT row_id, dataset_id, {temperature()} AS temperature FROM annotations"


def judge_kind_sql(t: str = "nat_instr_id") -> tuple[str, str]:
    gen = " ".join(f"WHEN contains({t}, {lit(k)}) THEN {lit(g)}" for k, g, _ in fixed.JUDGE_TASK_KINDS)
    comp = " ".join(f"WHEN contains({t}, {lit(k)}) THEN {lit(c)}" for k, _, c in fixed.JUDGE_TASK_KINDS)
    return f"(CASE {gen} ELSE 'other' END)", f"(CASE {comp} ELSE 'other' END)"


_GEN, _COMP = judge_kind_sql()
SQL["judge_kind"] = with_views("annotations") + f"SELECT row_id, nat_instr_id, {_GEN} AS doc_gen, {_COMP} AS doc_comp FROM annotations"

# ------------------------------------------------------------------------------------------------ time, histogram

_GAPS = """SELECT *, CASE WHEN user_id IS NOT NULL AND g < 600.0 THEN g ELSE 600.0 END AS gap_seconds
FROM (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST), ts)
                / 1e6 AS g FROM events)"""

SQL["annotation_gap"] = f"WITH gaps AS ({_GAPS})\nSELECT event_id, user_id, ts, gap_seconds FROM gaps"

_EVENT_LONG = f"""WITH gaps AS ({_GAPS}),
ecoh AS ({cohort_rules('events')}),
lab AS (SELECT g.*, CASE WHEN g.user_id % 4 IN (0, 1) THEN 'native' ELSE 'non_native' END AS native_or_not,
  CASE WHEN g.user_id % 4 = 0 THEN 'strict native' ELSE 'not strict native' END AS strict_native_or_not,
  {membership('g', 'ecoh')} FROM gaps g),
long AS ({unpivot('lab', EVENT4, 'event_type AS set_id, user_id, gap_seconds')})
"""

SQL["mean_gap_by_group"] = _EVENT_LONG + """
SELECT set_id, cohort_type, cohort, avg(gap_seconds) AS mean_gap_seconds FROM long
WHERE set_id IS NOT NULL AND cohort IS NOT NULL GROUP BY set_id, cohort_type, cohort
"""

SQL["total_time_by_group"] = _EVENT_LONG + """
, per_user AS (SELECT set_id, cohort_type, cohort, user_id, sum(gap_seconds) AS total FROM long
  WHERE set_id IS NOT NULL AND cohort IS NOT NULL AND user_id IS NOT NULL GROUP BY set_id, cohort_type, cohort, user_id)
SELECT set_id, cohort_type, cohort, avg(total) AS mean_total_seconds FROM per_user GROUP BY set_id, cohort_type, cohort
"""

SQL["rating_histogram"] = with_views("annotations", "cohorts", "labeled") + f"""
, scored AS (SELECT *, {accuracy()} AS acc FROM labeled),
vals AS (SELECT {', '.join(STATS4)},
   CAST(CASE WHEN dataset_id = 3 THEN {digit_sum('reply')} END AS DOUBLE) AS predicted,
   CAST(TRY_CAST(req_output AS INT) AS DOUBLE) AS req_output
   FROM scored WHERE dataset_id = 3 AND acc = 0),
long1 AS ({unpivot('vals', STATS4, 'predicted, req_output')}),
long AS (SELECT cohort_type, cohort, 'predicted' AS source, predicted AS value FROM long1
         UNION ALL SELECT cohort_type, cohort, 'req_output', req_output FROM long1),
binned AS (SELECT *, CASE WHEN value >= 0 AND value < 1 THEN 0 WHEN value >= 1 AND value < 2 THEN 1
                          WHEN value >= 2 AND value < 3 THEN 2 WHEN value >= 3 AND value < 4 THEN 3
                          WHEN value >= 4 AND value < 5 THEN 4 WHEN value >= 5 AND value <= 6 THEN 5 END AS bin FROM long),
grid AS (SELECT cohort_type, cohort, source, CAST(unnest(range(0, 6)) AS INT) AS bin
         FROM (SELECT DISTINCT cohort_type, cohort, source FROM long)),
counts AS (SELECT cohort_type, cohort, source, bin, count(*) AS n FROM binned WHERE bin IS NOT NULL
           GROUP BY cohort_type, cohort, source, bin)
SELECT g.cohort_type, g.cohort, g.source, g.bin, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN counts c ON c.cohort_type = g.cohort_type AND c.cohort = g.cohort AND c.source = g.source AND c.bin = g.bin
"""

# ------------------------------------------------------------------------------------------------ history sampling

def _bucket(size: str) -> str:
    return f"({md5_60('CAST(row_id AS VARCHAR)')} % CAST(ceil({size} / 4096.0) AS BIGINT))"


def history_sql(source: str, pool: str, n: int = 5, seed=fixed.SEED) -> str:
    """Views ``pool`` and ``hist(row_id, history)`` over ``source`` (a view name)."""
    if pool == "user":
        own = f"(SELECT *, user_id AS pool, count(*) OVER (PARTITION BY user_id) AS size FROM {source} WHERE user_id IS NOT NULL)"
        rows = "SELECT row_id, pool, pos AS own, size - 1 AS m FROM pool"
    else:
        member = ("" if pool == "native" else "NOT ") + "contains(nat_lang, 'en')"
        own = f"(SELECT *, {lit(pool)} AS pool, count(*) OVER () AS size FROM {source} WHERE {member})"
        rows = f"""SELECT s.row_id, {lit(pool)} AS pool, p.pos AS own,
   (SELECT count(*) FROM pool) - CASE WHEN p.pos IS NULL THEN 0 ELSE 1 END AS m
   FROM {source} s LEFT JOIN pool p ON p.row_id = s.row_id"""
    pool_sql = f"""SELECT row_id, pool, prompt_en, row_number() OVER (PARTITION BY pool ORDER BY {_bucket('size')}, row_id) - 1 AS pos, size
   FROM {own}"""
    draws = floyd("m", n, seed, "row_id")
    qs = [f"({d} + CASE WHEN own IS NOT NULL AND {d} >= own THEN 1 ELSE 0 END)" for d in draws]
    return f""", pool AS ({pool_sql}),
rows_ AS ({rows}),
picks AS (SELECT row_id, pool, unnest(range({n})) AS i, unnest([{', '.join(qs)}]) AS q FROM rows_ WHERE m >= {n}),
hist AS (SELECT k.row_id, string_agg(p.prompt_en, ', ' ORDER BY k.i) AS history
         FROM picks k JOIN pool p ON p.pool = k.pool AND p.pos = k.q GROUP BY k.row_id)
"""


SQL["history_sample_user"] = with_views("annotations") + history_sql("annotations", "user") + """
SELECT a.row_id, h.history FROM annotations a LEFT JOIN hist h ON h.row_id = a.row_id
"""

SQL["history_sample_cohort"] = with_views("annotations") + history_sql("annotations", "native") + """
SELECT a.row_id, h.history FROM annotations a LEFT JOIN hist h ON h.row_id = a.row_id
"""

SQL["history_sample_non_native"] = with_views("annotations") + history_sql("annotations", "non_native") + """
SELECT a.row_id, h.history FROM annotations a LEFT JOIN hist h ON h.row_id = a.row_id
"""

# ------------------------------------------------------------------------------------------------ chats

_FINAL = fill("instruction", "prompt_en")
_VALID = f"(SELECT *, {temperature()} AS temperature FROM annotations WHERE validated = 1)"

SQL["chat_standard"] = with_views("annotations") + chat_rows(_VALID + " v", [
    ("system", lit(fixed.SYSTEM_DEFAULT)), ("user", task_def()), ("assistant", lit(fixed.ACK_UNDERSTOOD)), ("user", _FINAL)])

SQL["chat_native"] = with_views("annotations") + chat_rows(_VALID + " v", [
    ("system", lit(fixed.SYSTEM_NATIVE)), ("user", task_def()), ("assistant", lit(fixed.ACK_UNDERSTOOD)), ("user", _FINAL)])

SQL["chat_trial"] = with_views("annotations") + chat_rows(_VALID + " v", [
    ("system", f"{lit(fixed.SYSTEM_DEFAULT + ' ')} || {task_def()}"), ("user", _FINAL)])

_GUESS = "(['a native one', 'a non-native writer', 'non-native, not a native', 'unclear'])[row_id % 4 + 1]"
_GQ = f"{lit(fixed.GUESS_QUESTION)} || prompt_en"
SQL["chat_guess"] = with_views("annotations") + chat_rows(
    f"(SELECT row_id, 'a' AS stage, 0.0::DOUBLE AS temperature, prompt_en FROM annotations WHERE validated = 1) v",
    [("system", lit(fixed.SYSTEM_DEFAULT)), ("user", _GQ)], keys=("row_id", "stage", "temperature"),
) + "\nUNION ALL " + chat_rows(
    f"(SELECT *, 'b' AS stage FROM {_VALID}) v",
    [("system", lit(fixed.SYSTEM_DEFAULT)), ("user", _GQ), ("assistant", _GUESS),
     ("user", f"{lit(fixed.GUESS_FOLLOW_UP)} || {task_def()}"), ("assistant", lit(fixed.ACK_UNDERSTOOD)), ("user", _FINAL)],
    keys=("row_id", "stage", "temperature"),
)

SQL["chat_history"] = with_views("annotations") + f", valid AS {_VALID}" + history_sql("valid", "user") + f"""
, hv AS (SELECT v.*, h.history FROM valid v JOIN hist h ON h.row_id = v.row_id)
""" + chat_rows("hv", [
    ("system", lit(fixed.SYSTEM_DEFAULT)), ("user", f"{lit(fixed.HISTORY_INTRO)} || history"),
    ("assistant", lit(fixed.ACK_OK)), ("user", task_def()), ("assistant", lit(fixed.ACK_UNDERSTOOD)), ("user", _FINAL)])

SQL["chat_history_native"] = with_views("annotations") + f", valid AS {_VALID}" + history_sql("valid", "native") + f"""
, hv AS (SELECT v.*, h.history FROM valid v JOIN hist h ON h.row_id = v.row_id)
""" + chat_rows("hv", [
    ("system", lit(fixed.SYSTEM_DEFAULT)), ("user", f"{lit(fixed.HISTORY_INTRO)} || history"),
    ("assistant", lit(fixed.ACK_OK)), ("user", task_def()), ("assistant", lit(fixed.ACK_UNDERSTOOD)), ("user", _FINAL)])

SQL["chat_non_native"] = with_views("annotations") + chat_rows(_VALID + " v", [
    ("system", lit(fixed.SYSTEM_NON_NATIVE)), ("user", task_def()), ("assistant", lit(fixed.ACK_UNDERSTOOD)), ("user", _FINAL)])

_WRITER_USER = (f"{lit(fixed.WRITER_TASK)} || {task_def()} || {lit(fixed.WRITER_INSTRUCTION)} || {strip_tags('instruction')}"
                f" || {lit(fixed.WRITER_DESIRED)} || req_output")
SQL["chat_gold"] = with_views("annotations") + f"""
, ga AS (SELECT *, 'a' AS stage, 0.0::DOUBLE AS temperature, {_WRITER_USER} AS wu FROM annotations),
gb AS (SELECT * EXCLUDE (stage, temperature), 'b' AS stage, {temperature()} AS temperature, {echo('wu')} AS written FROM ga)
""" + chat_rows("ga", [("system", lit(fixed.SYSTEM_PROMPT_WRITER)), ("user", "wu")], keys=("row_id", "stage", "temperature")) + \
    "\nUNION ALL " + chat_rows("(SELECT row_id, stage, temperature, task_def, dataset_id, instruction, written FROM gb) b", [
        ("system", lit(fixed.SYSTEM_DEFAULT)), ("user", task_def()), ("assistant", lit(fixed.ACK_UNDERSTOOD)),
        ("user", fill("instruction", "written"))], keys=("row_id", "stage", "temperature"))

# ------------------------------------------------------------------------------------------------ inference

SQL["infer_stub"] = with_views("annotations") + f"""
SELECT row_id, 'model_a' AS model, 'standard' AS mode, {echo(_FINAL)} AS reply, CAST(NULL AS VARCHAR) AS error
FROM annotations WHERE validated = 1
"""

SQL["guess_two_stage"] = with_views("annotations") + f"""
SELECT row_id, 'model_a' AS model, 'guess_native' AS mode, {temperature()} AS temperature, {echo(_GQ)} AS side_output, {echo(_FINAL)} AS reply,
       CAST(NULL AS VARCHAR) AS error
FROM annotations WHERE validated = 1
"""

_PROMPT_INSTRUCTION = "('Write it for <markprompt>[Your Prompt]</markprompt>. ' || instruction)"
_GOLD_USER = (f"{lit(fixed.WRITER_TASK)} || {task_def()} || {lit(fixed.WRITER_INSTRUCTION)} || {strip_tags(_PROMPT_INSTRUCTION)}"
              f" || {lit(fixed.WRITER_DESIRED)} || req_output")
SQL["gold_two_stage"] = with_views("annotations") + f"""
, asked AS (SELECT *, {_GOLD_USER} AS wu, {_PROMPT_INSTRUCTION} AS pi FROM annotations),
written AS (SELECT *, {echo('wu')} AS written FROM asked)
SELECT row_id, 'model_a' AS model, 'gold' AS mode, {temperature()} AS temperature, written AS side_output, {echo(fill('pi', 'written'))} AS reply,
       CAST(NULL AS VARCHAR) AS error
FROM written
"""

SQL["chat_gold_true"] = with_views("annotations") + chat_rows(_VALID + " v", [
    ("system", lit(fixed.SYSTEM_DEFAULT)), ("user", task_def()), ("assistant", lit(fixed.ACK_UNDERSTOOD)), ("user", "instruction")])

SQL["stream_resume"] = SQL["infer_stub"]

SQL["resume_pending"] = with_views("annotations", "runs") + """
, wanted AS (SELECT row_id, 'model_a' AS model,
   unnest(['standard', 'add_all_native', 'add_all_non_native', 'guess_native', 'add_history']) AS mode
   FROM annotations WHERE validated = 1)
SELECT row_id, model, mode FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.row_id = w.row_id AND r.model = w.model AND r.mode = w.mode
                  AND r.reply IS NOT NULL)
"""

# ------------------------------------------------------------------------------------------------ judge


def render(template: str, gen: str = "gen", comp: str = "comp") -> str:
    parts = []
    for piece in template.split("{gen}"):
        sub = piece.split("{comp}")
        parts.append(f" || {comp} || ".join(lit(s) for s in sub))
    return "(" + f" || {gen} || ".join(parts) + ")"


_HEAD_ONE = f"{render(fixed.JUDGE_INTRO_ONE)} || {lit(chr(10) * 2)} || gen || {lit(': ' + chr(10))} || reply || {lit(' ' + chr(10) * 2 + ' ')}"


def _head_two(kind: str, criterion: str) -> str:
    before, after = {"article": {"coherence": ("", ""), "relevance": (" ", " ")}, "closing": {"coherence": (" ", " "), "relevance": (" ", "")},
                     "paraphrased": {"coherence": (" ", ""), "relevance": (" ", "")}}[kind][criterion]
    return (f"{render(fixed.JUDGE_INTRO_TWO)} || {lit(chr(10) * 2 + before)} || gen || {lit(': ' + chr(10) + after)} || reply || "
            f"{lit(' ' + chr(10) * 2 + ' ')} || comp || {lit(': ' + chr(10) + ' ')} || final || {lit(' ' + chr(10) * 2 + ' ')}")


_COH = (f"CASE WHEN contains(gen, 'article') THEN {_head_two('article', 'coherence')} || {render(fixed.JUDGE_COHERENCE_ARTICLE)} "
        f"WHEN contains(gen, 'closing') THEN {_head_two('closing', 'coherence')} || {render(fixed.JUDGE_COHERENCE_STORY)} "
        f"WHEN contains(gen, 'paraphrased') THEN {_head_two('paraphrased', 'coherence')} || {render(fixed.JUDGE_COHERENCE_PARAPHRASE)} END")
_REL = (f"CASE WHEN contains(gen, 'article') THEN {_head_two('article', 'relevance')} || {render(fixed.JUDGE_RELEVANCE)} "
        f"WHEN contains(gen, 'closing') THEN {_head_two('closing', 'relevance')} || {render(fixed.JUDGE_RELEVANCE_STORY)} "
        f"WHEN contains(gen, 'paraphrased') THEN {_head_two('paraphrased', 'relevance')} || {render(fixed.JUDGE_RELEVANCE)} END")

_JUDGED = f"""
, judged AS (SELECT row_id, model, mode, reply, {fill('instruction', 'prompt_en')} AS final, {_GEN} AS gen, {_COMP} AS comp
             FROM runs WHERE mode IN ('standard', 'add_all_native') AND dataset_id IN (1, 6, 7, 8)),
jp AS (SELECT row_id, model, mode, 0 AS k, 'fluency' AS criterion,
              CASE WHEN gen <> 'other' THEN {_HEAD_ONE} || {render(fixed.JUDGE_FLUENCY)} END AS prompt FROM judged
       UNION ALL SELECT row_id, model, mode, 1, 'coherence', {_COH} FROM judged
       UNION ALL SELECT row_id, model, mode, 2, 'relevance', {_REL} FROM judged)
"""

SQL["judge_prompts"] = with_views("annotations", "runs") + _JUDGED + "SELECT row_id, model, mode, k, criterion, prompt FROM jp"

_REQUEST_ID = "'request-' || CAST(row_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) || '-' || model || '-' || mode"
SQL["judge_requests_jsonl"] = with_views("annotations", "runs") + _JUDGED + f"""
SELECT model, mode, row_id - (row_id % 20) AS shard, {_REQUEST_ID} AS custom_id,
  CAST(json_object('custom_id', {_REQUEST_ID},
              'method', 'POST', 'url', {lit(fixed.JUDGE_REQUEST_URL)},
              'body', json_object('model', {lit(fixed.JUDGE_REQUEST_MODEL)},
                                  'messages', json_array(json_object('role', 'system', 'content', {lit(fixed.JUDGE_SYSTEM_REQUESTS)}),
                                                         json_object('role', 'user', 'content', prompt)),
                                  'max_tokens', {fixed.JUDGE_REQUEST_MAX_TOKENS})) AS VARCHAR) AS line
FROM jp WHERE prompt IS NOT NULL
"""

SQL["judge_regroup"] = with_views("annotations", "runs") + _JUDGED + f"""
, ans AS (SELECT row_id, model, mode, criterion, CASE WHEN prompt IS NOT NULL THEN {strip_ws(echo('prompt'))} END AS answer FROM jp)
SELECT row_id, model, mode, max(CASE WHEN criterion = 'fluency' THEN answer END) AS fluency,
       max(CASE WHEN criterion = 'coherence' THEN answer END) AS coherence,
       max(CASE WHEN criterion = 'relevance' THEN answer END) AS relevance
FROM ans GROUP BY row_id, model, mode
"""


# ------------------------------------------------------------------------------------------------ overlap metrics


def rtok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def tokens_sql(name: str, src: str, keys: str, hyp: str, ref: str) -> str:
    """CTE ``name`` (keys..., hc, rc, ht, rt): characters and words of both texts, split once per row."""
    chars = "CASE WHEN length({0}) = 0 THEN [] ELSE string_split({0}, '') END"
    return f""", {name} AS MATERIALIZED (SELECT {keys}, {chars.format(hyp)} AS hc, {chars.format(ref)} AS rc, {rtok(hyp)} AS ht, {rtok(ref)} AS rt FROM {src})
"""


def overlap_sql(name: str, tokens: str, keys: str, kind: str, orders) -> str:
    """CTE ``name`` (keys..., o_<n>...) of clipped n-gram overlaps from ``tokens_sql`` rows: one row per token, joined with
    those behind it."""
    sep, col = ("", "c") if kind == "char" else (" ", "t")
    window = f"OVER (PARTITION BY {keys} ORDER BY i)"
    ks = " AND ".join(f"h.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    pivots = ", ".join(f"coalesce(sum(CASE WHEN n = {n} THEN o END), 0) AS o_{n}" for n in orders)
    out = ""
    for side in ("h", "r"):
        grams = ", ".join(" || ".join(["x"] + [f"{lit(sep)} || lead(x, {k}) {window}" for k in range(1, n)]) + f" AS g{n}" for n in orders)
        each = " UNION ALL ".join(f"SELECT {keys}, {n} AS n, g{n} AS g, count(*) AS c FROM {name}_{side}w WHERE g{n} IS NOT NULL GROUP BY ALL" for n in orders)
        out += f""", {name}_{side}w AS MATERIALIZED (SELECT {keys}, {grams} FROM (SELECT {keys}, unnest({side}{col}) AS x, generate_subscripts({side}{col}, 1) AS i FROM {tokens})),
{name}_{side} AS ({each})
"""
    return out + f""", {name}_o AS (SELECT {', '.join('h.' + k.strip() for k in keys.split(','))}, h.n, sum(least(h.c, r.c)) AS o
             FROM {name}_h h JOIN {name}_r r ON {ks} AND h.n = r.n AND h.g = r.g GROUP BY ALL),
{name} AS (SELECT {keys}, {pivots} FROM {name}_o GROUP BY ALL)
"""


def bleu_expr(o: str, hyp: str, ref: str) -> str:
    c, r = f"length({hyp})", f"length({ref})"
    terms = " + ".join(
        f"0.25 * ln(CASE WHEN coalesce({o}.o_{n}, 0) > 0 THEN coalesce({o}.o_{n}, 0) / greatest({c} - {n - 1}, 1)::DOUBLE "
        f"ELSE 2.2250738585072014e-308 END)" for n in (1, 2, 3, 4))
    bp = f"(CASE WHEN {c} > {r} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE exp(1 - {r}::DOUBLE / {c}) END)"
    return f"(CASE WHEN coalesce({o}.o_1, 0) = 0 THEN 0.0 ELSE {bp} * exp({terms}) END)"


def f1(p: str, r: str) -> str:
    return f"(CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END)"


def rouge_n_expr(o: str, t: str, n: int) -> str:
    ht, rt = f"greatest(len({t}.ht) - {n - 1}, 0)", f"greatest(len({t}.rt) - {n - 1}, 0)"
    p = f"coalesce({o}.o_{n}, 0) / greatest({ht}, 1)::DOUBLE"
    r = f"coalesce({o}.o_{n}, 0) / greatest({rt}, 1)::DOUBLE"
    return f1(p, r)


def lcs_expr(h: str, r: str) -> str:
    return (f"list_reduce({h}, lambda prev, tok: list_reduce(range(1, len({r}) + 1), lambda acc, j: list_append(acc, "
            f"CASE WHEN tok = {r}[j] THEN prev[j] + 1 ELSE greatest(acc[j], prev[j + 1]) END), [0]), "
            f"list_transform(range(len({r}) + 1), lambda x: 0))[-1]")


def rouge_l_expr(t: str) -> str:
    """From the longest common subsequence ``lcs`` of ``lcs_sql``."""
    return f"(CASE WHEN len({t}.ht) = 0 OR len({t}.rt) = 0 THEN 0.0 ELSE {f1(f'{t}.lcs / len({t}.ht)::DOUBLE', f'{t}.lcs / len({t}.rt)::DOUBLE')} END)"


def lcs_sql(name: str, tokens: str) -> str:
    """CTE ``name``: the ``tokens_sql`` rows with the length of their longest common subsequence of words."""
    return f", {name} AS MATERIALIZED (SELECT *, CASE WHEN len(ht) > 0 AND len(rt) > 0 THEN {lcs_expr('ht', 'rt')} ELSE 0 END AS lcs FROM {tokens})\n"


_APPL = "(reply IS NOT NULL AND req_output IS NOT NULL AND dataset_id IN (1, 6, 7, 8))"
_APPL_SRC = f"(SELECT * FROM annotations WHERE {_APPL}) s"

_TOK = with_views("annotations") + tokens_sql("tok", _APPL_SRC, "row_id", "reply", "req_output")
SQL["char_bleu"] = _TOK + overlap_sql("oc", "tok", "row_id", "char", (1, 2, 3, 4)) + f"""
SELECT a.row_id, a.dataset_id, CASE WHEN {_APPL} THEN {bleu_expr('oc', 'reply', 'req_output')} END AS bleu
FROM annotations a LEFT JOIN oc ON oc.row_id = a.row_id
"""

for _n in (1, 2):
    SQL[f"rouge{_n}"] = _TOK + overlap_sql("ow", "tok", "row_id", "word", (1, 2)) + f"""
SELECT a.row_id, a.dataset_id, CASE WHEN {_APPL} THEN {rouge_n_expr('ow', 'tok', _n)} END AS rouge_{_n}
FROM annotations a LEFT JOIN ow ON ow.row_id = a.row_id LEFT JOIN tok ON tok.row_id = a.row_id
"""

SQL["rouge_l"] = _TOK + lcs_sql("lcs", "tok") + f"""
SELECT a.row_id, a.dataset_id, CASE WHEN {_APPL} THEN {rouge_l_expr('lcs')} END AS rouge_l
FROM annotations a LEFT JOIN lcs ON lcs.row_id = a.row_id
"""

def lsum_sql(name: str, src: str, keys: str, reply: str, gold: str) -> str:
    """CTE ``name`` (keys..., rouge_lsum): ROUGE-Lsum of the rows of ``src``. ``path_expr`` fills the table of a reference and a reply line, each cell
    with the length and the reference places that backtracking from it would visit."""
    def lines(x: str, words: str, no: str) -> str:
        return (f"(SELECT {keys}, unnest(range(1, len(l) + 1)) AS {no}, unnest(list_transform(l, lambda x: {rtok('x')})) AS {words} "
                f"FROM (SELECT {keys}, list_filter(string_split({x}, chr(10)), lambda x: length(x) > 0) AS l FROM {src}))")

    cell = ("CASE WHEN rt[i] = tok THEN {'n': prev[i].n + 1, 'p': list_append(prev[i].p, i)} "
            "WHEN prev[i + 1].n > acc[i].n THEN prev[i + 1] WHEN acc[i].n >= prev[i + 1].n THEN acc[i] END")
    # Places in the table are counted from 1: prev[i + 1] is the cell left of the one to fill, acc[i] the one above.
    zero = "{'n': 0::BIGINT, 'p': CAST([] AS BIGINT[])}"
    path = (f"list_reduce(ht, lambda prev, tok: list_reduce(range(1, len(rt) + 1), lambda acc, i: list_append(acc, {cell}), [{zero}]), "
            f"list_transform(range(len(rt) + 1), lambda x: {zero}))[-1].p")
    return f""", {name}_r AS MATERIALIZED {lines(gold, 'rt', 'rl')}, {name}_h AS MATERIALIZED {lines(reply, 'ht', 'hl')},
{name}_pair AS MATERIALIZED (SELECT DISTINCT rt, ht FROM {name}_r JOIN {name}_h USING ({keys}) WHERE len(rt) > 0 AND len(ht) > 0 AND list_has_any(rt, ht)),
{name}_path AS MATERIALIZED (SELECT rt, ht, {path} AS p FROM {name}_pair),
{name}_hit AS (SELECT {keys}, tok, count(*) AS n FROM (
    SELECT DISTINCT {keys}, rl, i, rt[i] AS tok FROM (SELECT {keys}, rl, rt, unnest(p) AS i FROM {name}_r JOIN {name}_h USING ({keys}) JOIN {name}_path USING (rt, ht)))
  GROUP BY {keys}, tok),
{name}_cnt AS (SELECT {keys}, tok, count(*) AS c FROM (SELECT {keys}, unnest(ht) AS tok FROM {name}_h) GROUP BY {keys}, tok),
{name}_sum AS (SELECT {keys}, sum(least(n, c)) AS hits FROM {name}_hit JOIN {name}_cnt USING ({keys}, tok) GROUP BY {keys}),
{name}_len AS (SELECT {keys}, sum(m) AS m, sum(n) AS n FROM (SELECT {keys}, len(rt) AS m, 0 AS n FROM {name}_r UNION ALL SELECT {keys}, 0, len(ht) FROM {name}_h) GROUP BY {keys}),
{name} AS (SELECT {keys}, CASE WHEN coalesce(m, 0) = 0 OR coalesce(n, 0) = 0 THEN 0.0
             ELSE {f1('coalesce(hits, 0) / n::DOUBLE', 'coalesce(hits, 0) / m::DOUBLE')} END AS rouge_lsum
           FROM (SELECT {keys} FROM {src}) LEFT JOIN {name}_len USING ({keys}) LEFT JOIN {name}_sum USING ({keys}))
"""


SQL["rouge_lsum"] = with_views("annotations") + lsum_sql("ls", _APPL_SRC, "row_id", "reply", "req_output") + f"""
SELECT a.row_id, a.dataset_id, CASE WHEN {_APPL} THEN ls.rouge_lsum END AS rouge_lsum FROM annotations a LEFT JOIN ls ON ls.row_id = a.row_id
"""

SQL["dataset_8"] = with_views("annotations") + "SELECT row_id, dataset_id, prompt_en, reply FROM annotations WHERE dataset_id = 8"

SQL["full_instruction"] = with_views("annotations") + f"SELECT row_id, {task_def()} || ' ' || {_FINAL} AS full_instruction FROM annotations"

SQL["filled_accuracy"] = with_views("annotations", "runs", "runs_labeled") + f"""
, sc AS (SELECT *, CASE WHEN dataset_id IN (0, 2, 3, 4, 5, 9) THEN coalesce({accuracy()}, 0) ELSE {accuracy()} END AS acc,
     coalesce({guess_label('side_output')} = native_or_not, false) AS correct FROM runs_labeled),
ex AS (SELECT *, unnest(CASE WHEN mode = 'guess_native' AND correct THEN ['guess_native', 'guess_native_correct']
                             ELSE [CASE mode WHEN 'standard' THEN 'standard' WHEN 'add_all_native' THEN 'native'
                                             WHEN 'add_all_non_native' THEN 'non_native' ELSE mode END] END) AS run FROM sc),
per AS (SELECT model, run, native_or_not, example_id, avg(acc) AS a FROM ex WHERE example_id IS NOT NULL GROUP BY ALL)
SELECT model, run, native_or_not, avg(a) AS accuracy FROM per GROUP BY model, run, native_or_not
"""

_ALIASES = ", ".join(f"({i}, {lit(a)}, {lit(d)}, {lit(c)})" for i, (a, d, c) in enumerate([*fixed.MODEL_ALIASES, ("other", "other", "other")]))
SQL["model_names"] = with_views("annotations") + f"""
, names(i, model, display, checkpoint) AS (VALUES {_ALIASES})
SELECT row_id, model, display, checkpoint FROM annotations JOIN names ON names.i = row_id % {len(fixed.MODEL_ALIASES) + 1}
"""

SQL["gold_join"] = with_views("annotations", "gold") + """
SELECT a.row_id, a.nat_instr_id, g.generated_req_output FROM annotations a JOIN gold g ON g.nat_instr_id = a.nat_instr_id
"""

def hash_unit(*parts: str) -> str:
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({key}), 1, 4)) AS INT) / 65535.0 - 0.5)"


def match_sql(tv: str, keys: str, name: str) -> str:
    """CTE ``name`` (keys..., precision, recall, f1) of the greedy token match over ``tv`` (keys..., side, pos, vec)."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"g.{k} = r.{k}" for k in ks)
    rk = ", ".join(f"r.{k}" for k in ks)
    return f"""{name}_s AS (SELECT {rk}, r.pos AS rp, g.pos AS gp, list_cosine_similarity(CAST(r.vec AS DOUBLE[]), CAST(g.vec AS DOUBLE[])) AS s
         FROM {tv} r JOIN {tv} g ON {on} AND r.side = 'reply' AND g.side = 'gold'),
{name}_p AS (SELECT {keys}, avg(m) AS precision FROM (SELECT {keys}, rp, max(s) AS m FROM {name}_s GROUP BY {keys}, rp) GROUP BY {keys}),
{name}_r AS (SELECT {keys}, avg(m) AS recall FROM (SELECT {keys}, gp, max(s) AS m FROM {name}_s GROUP BY {keys}, gp) GROUP BY {keys}),
{name} AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) END AS f1
       FROM (SELECT DISTINCT {keys} FROM {tv}) LEFT JOIN {name}_p USING ({keys}) LEFT JOIN {name}_r USING ({keys}))"""


def tokens_of(pairs: str, keys: str) -> str:
    return f"""side_text AS (SELECT {keys}, 'reply' AS side, reply AS t FROM {pairs} UNION ALL SELECT {keys}, 'gold', gold FROM {pairs}),
toks AS (SELECT {keys}, side, CAST(unnest(range(len(tk))) AS INT) AS pos, unnest(tk) AS token
         FROM (SELECT {keys}, side, {rtok("t")} AS tk FROM side_text))"""


def logprobs_of(pairs: str, keys: str, refs: int) -> str:
    ks = [k.strip() for k in keys.split(",")]
    row = " || ':' || ".join(f"CAST(s.{k} AS VARCHAR)" for k in ks)
    on = " AND ".join(f"t.{k} = s.{k}" for k in ks)
    return f"""lp AS (SELECT {', '.join('s.' + k for k in ks)}, s.direction, s.ref_idx, t.pos,
     ({hash_unit('s.direction', 's.ref_idx', row, 't.pos', 't.token')} - 0.5) * 8.0 AS logprob,
     {hash_unit("'pad'", row, 's.direction', 's.ref_idx', 't.pos')} > 0.4 AS is_pad
   FROM (SELECT {keys}, d.direction, d.side, unnest(range({refs})) AS ref_idx FROM {pairs},
         (SELECT 'faithful' AS direction, 'reply' AS side UNION ALL SELECT 'precision', 'reply'
          UNION ALL SELECT 'recall', 'gold') d) s
   JOIN toks t ON {on} AND t.side = s.side)"""


def loglik_sql(keys: str, name: str) -> str:
    return f"""{name}_per AS (SELECT {keys}, direction, sum(CASE WHEN NOT is_pad THEN logprob END) / nullif(count_if(NOT is_pad), 0) AS score
        FROM lp GROUP BY {keys}, direction),
{name} AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM (
  SELECT {keys}, max(CASE WHEN direction = 'faithful' THEN score END) AS faithful, max(CASE WHEN direction = 'precision' THEN score END) AS precision,
         max(CASE WHEN direction = 'recall' THEN score END) AS recall FROM {name}_per GROUP BY {keys}))"""


_TV_OF_TOKS = f"tv AS (SELECT *, list_transform(range(0, 8), lambda i: CAST({hash_unit('token', 'i')} AS FLOAT)) AS vec FROM toks)"

_RUN_APPL = "(reply IS NOT NULL AND generated_req_output IS NOT NULL AND dataset_id IN (1, 6, 7, 8))"
_RUN_SRC = f"(SELECT * FROM lab WHERE {_RUN_APPL}) s"
_SCORED_RUNS = with_views("annotations", "gold", "runs") + f"""
, lab AS (SELECT r.*, g.generated_req_output,
     CASE WHEN contains(r.nat_lang, 'en') THEN 'native' ELSE 'non_native' END AS native_or_not,
     {accuracy()} AS accuracy
   FROM runs r JOIN gold g ON g.nat_instr_id = r.nat_instr_id)
""" + tokens_sql("tok", _RUN_SRC, "row_id, model, mode", "reply", "generated_req_output") + lcs_sql("lcs", "tok") \
    + overlap_sql("oc", "tok", "row_id, model, mode", "char", (1, 2, 3, 4)) \
    + overlap_sql("ow", "tok", "row_id, model, mode", "word", (1, 2)) + f"""
, pairs AS (SELECT row_id, model, mode, reply, generated_req_output AS gold FROM lab WHERE dataset_id IN (1, 6, 7, 8) AND reply IS NOT NULL),
{tokens_of('pairs', 'row_id, model, mode')},
{_TV_OF_TOKS},
{match_sql('tv', 'row_id, model, mode', 'bert')},
{logprobs_of('pairs', 'row_id, model, mode', 1)},
{loglik_sql('row_id, model, mode', 'bart')}
, scored AS (
  SELECT l.*, coalesce({guess_label('l.side_output')} = l.native_or_not, false) AS correct,
    CASE WHEN {_RUN_APPL} THEN {bleu_expr('oc', 'reply', 'generated_req_output')} END AS bleu,
    CASE WHEN {_RUN_APPL} THEN {rouge_n_expr('ow', 'lcs', 1)} END AS rouge_1,
    CASE WHEN {_RUN_APPL} THEN {rouge_n_expr('ow', 'lcs', 2)} END AS rouge_2,
    CASE WHEN {_RUN_APPL} THEN {rouge_l_expr('lcs')} END AS rouge_l,
    bert.precision AS bertscore_precision, bert.recall AS bertscore_recall, bert.f1 AS bertscore_f1,
    bart.faithful AS bartscore_faithful, bart.precision AS bartscore_precision, bart.recall AS bartscore_recall, bart.f1 AS bartscore_f1
  FROM lab l
  LEFT JOIN bert ON bert.row_id = l.row_id AND bert.model = l.model AND bert.mode = l.mode
  LEFT JOIN bart ON bart.row_id = l.row_id AND bart.model = l.model AND bart.mode = l.mode
  LEFT JOIN oc ON oc.row_id = l.row_id AND oc.model = l.model AND oc.mode = l.mode
  LEFT JOIN ow ON ow.row_id = l.row_id AND ow.model = l.model AND ow.mode = l.mode
  LEFT JOIN lcs ON lcs.row_id = l.row_id AND lcs.model = l.model AND lcs.mode = l.mode)
"""

_METRICS = tuple(m for m in fixed.ALL_METRICS if m != "rouge_lsum")

SQL["scores_all"] = _SCORED_RUNS + f"SELECT row_id, model, mode, {', '.join(_METRICS)} FROM scored"

def _run_long(scored: str, metrics: tuple[str, ...]) -> str:
    return scored + f"""
, ex AS (SELECT *, unnest(CASE WHEN mode = 'guess_native' AND correct THEN ['guess_native', 'guess_native_correct']
                               ELSE [CASE mode WHEN 'standard' THEN 'standard' WHEN 'add_all_native' THEN 'native'
                                               WHEN 'add_all_non_native' THEN 'non_native' ELSE mode END] END) AS run
         FROM scored),
per_ex AS (SELECT model, run, native_or_not, example_id, {', '.join(f'avg({m}) AS {m}' for m in metrics)}
           FROM ex WHERE example_id IS NOT NULL GROUP BY model, run, native_or_not, example_id),
long AS (SELECT model, run, native_or_not, {', '.join(f'avg({m}) AS {m}' for m in metrics)}
         FROM per_ex GROUP BY model, run, native_or_not)
"""


_RUN_LONG = _run_long(_SCORED_RUNS, _METRICS)

SQL["run_comparison"] = _RUN_LONG + "SELECT * FROM long"

_RUN_TEXTS = f"(SELECT DISTINCT row_id, reply, generated_req_output FROM lab WHERE {_RUN_APPL}) s"
SQL["run_comparison_all"] = _run_long(
    _SCORED_RUNS.replace(", scored AS (", ", scored12 AS (")
    + lsum_sql("ls", _RUN_TEXTS, "row_id, reply, generated_req_output", "reply", "generated_req_output")
    + ", scored AS (SELECT s.*, ls.rouge_lsum FROM scored12 s LEFT JOIN ls USING (row_id, reply, generated_req_output))\n",
    fixed.ALL_METRICS) + "SELECT * FROM long"

_PIVOT_COLS = [(r, c) for r in fixed.RUN_LABELS for c in fixed.NATIVE_LABELS]
SQL["comparison_pivot"] = _RUN_LONG + "\nUNION ALL ".join(
    f"SELECT '{m}' AS metric, " + ", ".join(
        f"round_even(max(CASE WHEN run = '{r}' AND native_or_not = '{c}' THEN {m} END) * 100, 0) / 100 AS model_a_{r}_{c}"
        for r, c in _PIVOT_COLS) + " FROM long"
    for m in _METRICS)
SQL["comparison_pivot"] = SQL["comparison_pivot"].replace(_RUN_LONG, _RUN_LONG + "SELECT * FROM (", 1) + ")"

SQL["missing_counts"] = with_views("annotations", "gold", "runs") + f"""
, s AS (SELECT r.*, {accuracy()} AS accuracy, g.generated_req_output FROM runs r JOIN gold g ON g.nat_instr_id = r.nat_instr_id)
SELECT model, mode, CAST(count_if(dataset_id IN (0, 2, 3, 4, 5, 9) AND accuracy IS NULL) AS BIGINT) AS missing_accuracy,
       CAST(count_if(dataset_id IN (1, 6, 7, 8) AND (reply IS NULL OR generated_req_output IS NULL)) AS BIGINT) AS missing_bleu
FROM s GROUP BY model, mode
"""


# ------------------------------------------------------------------------------------------------ model-based scores


_PAIRS = """pairs AS (SELECT CAST(a.conv_id AS VARCHAR) || ':' || CAST(a.turn AS VARCHAR) AS row_id, a.text AS reply, u.text AS gold
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user'
  WHERE a.role = 'assistant'),
""" + tokens_of("pairs", "row_id")

SQL["greedy_match_score"] = f"WITH {_PAIRS},\n{_TV_OF_TOKS},\n{match_sql('tv', 'row_id', 'm')}\nSELECT row_id, precision, recall, f1 FROM m"

SQL["loglik_score"] = f"WITH {_PAIRS},\n{logprobs_of('pairs', 'row_id', 1)},\n{loglik_sql('row_id', 'w')}\nSELECT * FROM w"

_LP = logprobs_of("pairs", "row_id", 2)
SQL["multi_ref_score"] = f"WITH {_PAIRS},\n{_LP}" + """,
per AS (SELECT row_id, ref_idx, sum(CASE WHEN NOT is_pad THEN logprob END) / nullif(count_if(NOT is_pad), 0) AS score
        FROM lp WHERE direction = 'precision' GROUP BY row_id, ref_idx)
SELECT row_id, avg(score) AS mean_score, max(score) AS max_score FROM per GROUP BY row_id
"""

# ------------------------------------------------------------------------------------------------ embeddings

_SCALED = """e AS (SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INT) AS dim, unnest(embedding) AS x
                   FROM embeddings WHERE embedding IS NOT NULL),
st AS (SELECT label, dim, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY label, dim),
scaled AS (SELECT e.vec_id, e.label, e.dim, (e.x - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END AS value
           FROM e JOIN st ON st.label = e.label AND st.dim = e.dim)"""

SQL["standardize_vectors"] = f"WITH {_SCALED}\nSELECT vec_id, label, dim, value FROM scaled"

SQL["group_covariance"] = f"WITH {_SCALED}" + """
SELECT a.label, a.dim AS i, b.dim AS j, CASE WHEN count(*) > 1 THEN covar_samp(a.value, b.value) ELSE 0.0 END AS cov
FROM scaled a JOIN scaled b ON a.vec_id = b.vec_id AND a.label = b.label AND a.dim <= b.dim GROUP BY a.label, a.dim, b.dim
"""

SQL["cosine_knn"] = f"WITH {_SCALED}" + """,
sc AS (SELECT vec_id, label, list(value ORDER BY dim) AS v FROM scaled GROUP BY vec_id, label),
pairs AS (SELECT a.label, a.vec_id, b.vec_id AS neighbor_id, list_cosine_similarity(a.v, b.v) AS sim
          FROM sc a JOIN sc b ON a.label = b.label AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY sim DESC, neighbor_id) AS rank FROM pairs)
SELECT label, vec_id, CAST(rank AS INT) AS rank, neighbor_id FROM ranked WHERE rank <= 15
"""

SQL["cosine_knn_lsh"] = SQL["cosine_knn"]  # its groups fit in one bucket here


# Squarings of a matrix: as many steps of power iteration as 2 to this number.
ROUNDS = 14


def leading_sql(name: str, src: str, m: str) -> str:
    """CTE ``name``: the rows of ``src`` with ``v``, the leading unit eigenvector of the matrix ``m`` (its largest entry positive)."""
    def trace(x: str) -> str:
        return f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i][i]))"

    def scaled(x: str) -> str:
        return f"(CASE WHEN {trace(x)} = 0 THEN {x} ELSE list_transform({x}, lambda r: list_transform(r, lambda y: y / {trace(x)})) END)"

    # Each round squares, then scales: two steps, so that the square is computed once.
    rounds = ""
    for k in range(ROUNDS):
        last = f"{name}_s{k - 1}" if k else f"{name}_s"
        rounds += (f"{name}_q{k} AS MATERIALIZED (SELECT label, list_transform(s, lambda r: list_transform(s, lambda c: list_dot_product(r, c))) AS q FROM {last}),\n"
                   f"{name}_t{k} AS MATERIALIZED (SELECT label, q, {trace('q')} AS t FROM {name}_q{k}),\n"
                   f"{name}_s{k} AS MATERIALIZED (SELECT label, CASE WHEN t = 0 THEN q ELSE list_transform(q, lambda r: list_transform(r, lambda y: y / t)) END AS s FROM {name}_t{k}),\n")
    return f"""{name}_s AS MATERIALIZED (SELECT label, {scaled(m)} AS s FROM {src}),
{rounds}{name}_d AS (SELECT label, s, list_transform(range(1, len(s) + 1), lambda i: s[i][i]) AS d FROM {name}_s{ROUNDS - 1}),
{name}_c AS (SELECT label, s[list_position(d, list_max(d))] AS c FROM {name}_d),
{name}_u AS (SELECT label, c, sqrt(list_dot_product(c, c)) AS size, list_transform(c, lambda y: abs(y)) AS a FROM {name}_c),
{name} AS MATERIALIZED (SELECT {src}.*, CASE WHEN size = 0 THEN c ELSE list_transform(c, lambda y: y * CASE WHEN c[list_position(a, list_max(a))] < 0 THEN -1.0 ELSE 1.0 END / size) END AS v
  FROM {src} JOIN {name}_u USING (label))"""


_PCA = f"WITH {_SCALED}" + f""",
cell AS (SELECT a.label, a.dim AS i, b.dim AS j, CASE WHEN count(*) > 1 THEN covar_samp(a.value, b.value) ELSE 0.0 END AS cov
         FROM scaled a JOIN scaled b ON a.vec_id = b.vec_id AND a.label = b.label GROUP BY a.label, a.dim, b.dim),
mat AS MATERIALIZED (SELECT label, list(r ORDER BY i) AS m FROM (SELECT label, i, list(cov ORDER BY j) AS r FROM cell GROUP BY label, i) GROUP BY label),
{leading_sql('one', 'mat', 'm')},
eig AS MATERIALIZED (SELECT label, m, v AS c1, list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) AS l FROM one),
rest AS MATERIALIZED (SELECT label, c1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * c1[i] * c1[j])) AS m FROM eig),
{leading_sql('two', 'rest', 'm')},
mean AS (SELECT label, dim, avg(value) AS mu FROM scaled GROUP BY label, dim),
points AS (SELECT s.label, s.vec_id, sum((s.value - mu) * c1[s.dim + 1]) AS pc1, sum((s.value - mu) * v[s.dim + 1]) AS pc2
           FROM scaled s JOIN mean USING (label, dim) JOIN two USING (label) GROUP BY s.label, s.vec_id)
"""
SQL["pca_2d"] = _PCA + "SELECT label, vec_id, pc1, pc2 FROM points"
SQL["projected_points"] = _PCA + f""", a AS ({V['annotations']})
SELECT label, vec_id, CASE WHEN contains(nat_lang, 'en') THEN 'native' ELSE 'non_native' END AS native_or_not,
       CASE WHEN nat_lang = '{{en}}' THEN 'strict native' ELSE 'not strict native' END AS strict_native_or_not, pc1, pc2
FROM points JOIN a ON a.row_id = vec_id
"""


_RUN_LONG_DS = _SCORED_RUNS + f"""
, ex AS (SELECT *, unnest(CASE WHEN mode = 'guess_native' AND correct THEN ['guess_native', 'guess_native_correct']
                               ELSE [CASE mode WHEN 'standard' THEN 'standard' WHEN 'add_all_native' THEN 'native'
                                               WHEN 'add_all_non_native' THEN 'non_native' ELSE mode END] END) AS run
         FROM scored),
per_ex AS (SELECT model, run, native_or_not, dataset_id, example_id, {', '.join(f'avg({m}) AS {m}' for m in _METRICS)}
           FROM ex WHERE example_id IS NOT NULL AND dataset_id IS NOT NULL
           GROUP BY model, run, native_or_not, dataset_id, example_id),
long AS (SELECT model, run, native_or_not, dataset_id, {', '.join(f'avg({m}) AS {m}' for m in _METRICS)}
         FROM per_ex GROUP BY model, run, native_or_not, dataset_id)
"""

SQL["comparison_pivot_dataset"] = _RUN_LONG_DS + "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT dataset_id, '{m}' AS metric, " + ", ".join(
        f"round_even(max(CASE WHEN run = '{r}' AND native_or_not = '{c}' THEN {m} END) * 100, 0) / 100 AS model_a_{r}_{c}"
        for r, c in _PIVOT_COLS) + " FROM long GROUP BY dataset_id"
    for m in _METRICS) + ")"


# ------------------------------------------------------------------------------------------------ wide files, E1, S9

SQL["wide_results_roundtrip"] = with_views("annotations", "runs") + """
SELECT row_id, 'gpt3' AS model, mode, reply, side_output FROM runs
"""

SQL["wide_scores_roundtrip"] = with_views("annotations", "runs") + f"""
SELECT row_id, 'gpt3' AS model, mode, reply, CASE WHEN mode = 'standard' THEN {accuracy()} END AS accuracy,
       CASE WHEN mode = 'standard' THEN '[-' || length(reply) || ']' END AS logprobs
FROM runs WHERE mode IN ('standard', 'add_all_native')
"""

SQL["infer_logprobs"] = with_views("annotations") + f"""
, asked AS (SELECT row_id, length({_FINAL}) AS n FROM annotations WHERE validated = 1)
SELECT row_id, 'model_a' AS model, 'standard' AS mode, CAST(n AS VARCHAR) AS reply,
       '[{{"token": "' || n || '", "logprob": ' || CAST(-n / 8.0::DOUBLE AS VARCHAR) || '}}]' AS logprobs, CAST(NULL AS VARCHAR) AS error
FROM asked
"""

SQL["decoding_parameters"] = with_views("annotations") + f"""
SELECT row_id, dataset_id, {temperature()} AS temperature, CASE WHEN {temperature()} = 0 THEN NULL ELSE {fixed.SAMPLING_TOP_P}::DOUBLE END AS top_p,
       CAST(CASE WHEN {temperature()} = 0 THEN NULL ELSE {fixed.SAMPLING_TOP_K} END AS INT) AS top_k, CAST({fixed.MAX_NEW_TOKENS} AS INT) AS max_tokens,
       CAST({fixed.SEED} AS INT) AS seed, CAST({fixed.TOP_LOGPROBS} AS INT) AS top_logprobs, {fixed.JUDGE_TEMPERATURE}::DOUBLE AS judge_temperature,
       {fixed.JUDGE_TOP_P}::DOUBLE AS judge_top_p, CAST({fixed.JUDGE_MAX_TOKENS} AS INT) AS judge_max_tokens, CAST({fixed.SEED} AS INT) AS judge_seed
FROM annotations
"""

SQL["embed_texts"] = """
SELECT doc_id, CAST(unnest(range(3)) AS INT) AS dim,
       unnest([CAST(length(coalesce(text, '')) AS FLOAT),
               CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS FLOAT),
               CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS FLOAT)]) AS value
FROM documents
"""

SQL["scores_selected"] = with_views("annotations", "runs") + f"""
SELECT row_id, 'generated' AS approach, model, mode, 'main' AS report, {accuracy()} AS accuracy FROM runs WHERE mode IN ('standard', 'guess_native')
"""

SQL["report_csv"] = with_views("annotations", "gold") + f"""
, s AS (SELECT dataset_id, example_id, CASE WHEN contains(nat_lang, 'en') THEN 'native' ELSE 'non_native' END AS native_or_not,
          {accuracy('generated_req_output')} AS accuracy
        FROM annotations JOIN gold USING (nat_instr_id) WHERE validated = 1),
per AS (SELECT native_or_not, dataset_id, example_id, avg(accuracy) AS accuracy FROM s WHERE dataset_id IS NOT NULL AND example_id IS NOT NULL GROUP BY ALL)
SELECT native_or_not, dataset_id, avg(accuracy) AS accuracy FROM per GROUP BY native_or_not, dataset_id
"""

SQL["judge_request_manifest"] = "SELECT model, mode, shard, count(*) AS n_requests, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes FROM (" + \
    SQL["judge_requests_jsonl"] + ") GROUP BY model, mode, shard"
