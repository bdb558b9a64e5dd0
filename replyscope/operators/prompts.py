"""Prompt assembly: task definition with output suffix (P13), temperature (P14), system prompt by mode (P15),
final prompt (T1, T2), chat message arrays (C1–C8) and judge prompts (P18, C11, U4, U5).

Messages are ``ARRAY<STRUCT<role STRING, content STRING>>`` built with ``array(struct(...))``: pure Catalyst, one
projection, no join (the lookup tables are map literals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyscope.functions import fixed, text

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def task_definition(task_def="task_def", dataset_id="dataset_id") -> Column:
    """Task definition plus the output-format suffix of its dataset (none for datasets 0 and 2)."""
    suffix = F.coalesce(F.try_element_at(_map(fixed.TASK_SUFFIX), _c(dataset_id)), F.lit(""))
    return F.concat(_c(task_def), suffix)


def temperature(dataset_id="dataset_id") -> Column:
    """Sampling temperature of the dataset (NULL for an unknown id)."""
    return F.try_element_at(_map(fixed.TEMPERATURE), _c(dataset_id)).cast("double")


def system_prompt(mode: str) -> Column:
    """System prompt by mode."""
    if mode == "add_all_native":
        return F.lit(fixed.SYSTEM_NATIVE)
    if mode == "add_all_non_native":
        return F.lit(fixed.SYSTEM_NON_NATIVE)
    return F.lit(fixed.SYSTEM_DEFAULT)


def final_prompt(gold_mode="False", instruction="instruction", prompt="prompt_en",
                 prompt_instruction="prompt_instruction") -> Column:
    """The prompt sent as the last user turn. ``False``: the instruction with the annotator's prompt filled in;
    ``True``: the bare instruction; ``add_prompt_then_true``: the prompt instruction."""
    if gold_mode in (False, "False"):
        return text.fill_placeholder(instruction, prompt)
    if gold_mode in (True, "True"):
        return _c(instruction)
    if gold_mode == "add_prompt_then_true":
        return _c(prompt_instruction)
    raise ValueError(f"unknown gold mode {gold_mode!r}")


def full_instruction(task_def="task_def", prompt="final_prompt_en") -> Column:
    """``task_def + ' ' + prompt`` (the source text of the faithfulness score); NULL if either is NULL."""
    return F.concat(_c(task_def), F.lit(" "), _c(prompt))


def msg(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), _c(content).cast("string").alias("content"))


def chat(*turns: Column) -> Column:
    return F.array(*turns)


def standard_chat(system: Column, task: Column, prompt: Column) -> Column:
    """System, user(task definition), assistant(Understood), user(final prompt)."""
    return chat(msg("system", system), msg("user", task), msg("assistant", F.lit(fixed.ACK_UNDERSTOOD)), msg("user", prompt))


def guess_question_chat(system: Column, prompt_en: Column) -> Column:
    """C3 (a): ask for a guess about the writer; temperature 0."""
    return chat(msg("system", system), msg("user", F.concat(F.lit(fixed.GUESS_QUESTION), prompt_en)))


def guess_answer_chat(system: Column, prompt_en: Column, guess: Column, task: Column, prompt: Column) -> Column:
    """C3 (b): the guess exchange, then the task taking the guess into account."""
    return chat(
        msg("system", system),
        msg("user", F.concat(F.lit(fixed.GUESS_QUESTION), prompt_en)),
        msg("assistant", guess),
        msg("user", F.concat(F.lit(fixed.GUESS_FOLLOW_UP), task)),
        msg("assistant", F.lit(fixed.ACK_UNDERSTOOD)),
        msg("user", prompt),
    )


#: The turn of ``history_chat`` that holds the history; no other turn does, and it holds nothing else of the row.
HISTORY_TURN = 1


def history_chat(system: Column, history: Column, task: Column, prompt: Column) -> Column:
    """Earlier texts of the writer (no separator after the intro), then C1's tail."""
    return chat(
        msg("system", system),
        msg("user", F.concat(F.lit(fixed.HISTORY_INTRO), history)),
        msg("assistant", F.lit(fixed.ACK_OK)),
        msg("user", task),
        msg("assistant", F.lit(fixed.ACK_UNDERSTOOD)),
        msg("user", prompt),
    )


def prompt_writer_chat(task: Column, prompt: Column, desired: Column) -> Column:
    """C6 (a): ask for a prompt that fills the placeholder; temperature 0."""
    content = F.concat(
        F.lit(fixed.WRITER_TASK), task, F.lit(fixed.WRITER_INSTRUCTION), text.strip_tags(prompt),
        F.lit(fixed.WRITER_DESIRED), desired,
    )
    return chat(msg("system", F.lit(fixed.SYSTEM_PROMPT_WRITER)), msg("user", content))


def gold_answer_chat(task: Column, prompt: Column, written: Column) -> Column:
    """C6 (b): answer the prompt with the written text filled in."""
    return standard_chat(F.lit(fixed.SYSTEM_DEFAULT), task, text.fill_placeholder(prompt, written))


def trial_chat(system: Column, task: Column, prompt: Column) -> Column:
    """The task definition inside the system prompt, one user turn."""
    return chat(msg("system", F.concat(system, F.lit(" "), task)), msg("user", prompt))


# Mode precedence when options overlap, per client family.
PRECEDENCE = {
    "hosted_a": ("guess_native", "add_history", "gold", "standard"),
    "hosted_b": ("guess_native", "gold", "trial", "add_history", "add_history_native", "standard"),
    "local": ("guess_native", "gold", "add_history", "standard"),
}


def resolve_mode(mode: str, gold_mode="False", trial: bool = False, family: str = "hosted_b") -> str:
    """Which chat form a combination of options produces. Conflicting options raise instead of silently
    following one precedence."""
    requested = []
    if mode == "guess_native":
        requested.append("guess_native")
    if gold_mode == "add_prompt_then_true":
        requested.append("gold")
    if trial:
        requested.append("trial")
    if mode in ("add_history", "add_history_native"):
        requested.append(mode)
    if len(requested) > 1:
        raise ValueError(f"conflicting options {requested}; the original would silently use "
                         f"{next(m for m in PRECEDENCE[family] if m in requested)}")
    return requested[0] if requested else "standard"


def build_messages(df: DataFrame, mode: str = "standard", gold_mode="False", trial: bool = False,
                   history: str = "history", guess: str = "guess", written: str = "written_prompt") -> DataFrame:
    """Add ``final_prompt_en``, ``messages`` and ``temperature`` for one run mode (single-call modes and the second
    call of two-call modes; the first calls are ``guess_question_chat`` / ``prompt_writer_chat``)."""
    form = resolve_mode(mode, gold_mode, trial)
    out = df.withColumn("final_prompt_en", final_prompt(gold_mode))
    sys_p = system_prompt(mode)
    task = task_definition()
    prompt = F.col("final_prompt_en")
    if form == "guess_native":
        messages = guess_answer_chat(sys_p, F.col("prompt_en"), F.col(guess), task, prompt)
    elif form in ("add_history", "add_history_native"):
        messages = history_chat(sys_p, F.col(history), task, prompt)
    elif form == "gold":
        messages = gold_answer_chat(task, prompt, F.col(written))
    elif form == "trial":
        messages = trial_chat(sys_p, task, prompt)
    else:
        messages = standard_chat(sys_p, task, prompt)
    return out.withColumn("messages", messages).withColumn("temperature", temperature())


def flatten_messages(df: DataFrame, keys=("row_id",), messages: str = "messages") -> DataFrame:
    """One row per chat turn: (*keys, turn, role, content)."""
    return df.select(*keys, F.posexplode(messages).alias("turn", "m")).select(
        *keys, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


# ------------------------------------------------------------------------------------------------ judge


def judge_kind(task_id="nat_instr_id") -> tuple[Column, Column]:
    """(generated kind, compared kind) of the first task-id substring that matches, in the fixed order; else
    ``other``. A NULL task id is ``other``."""
    t = _c(task_id)
    gen, comp = F.lit("other"), F.lit("other")
    for key, g, c in reversed(fixed.JUDGE_TASK_KINDS):
        hit = F.coalesce(t.contains(key), F.lit(False))
        gen = F.when(hit, F.lit(g)).otherwise(gen)
        comp = F.when(hit, F.lit(c)).otherwise(comp)
    return gen, comp


def _fill(template: str, gen: Column, comp: Column) -> Column:
    """Format a rubric template with the row's document kinds (literal pieces joined by concat)."""
    parts: list[Column] = []
    rest = template
    while rest:
        i_g, i_c = rest.find("{gen}"), rest.find("{comp}")
        cands = [(i, tag) for i, tag in ((i_g, "{gen}"), (i_c, "{comp}")) if i >= 0]
        if not cands:
            parts.append(F.lit(rest))
            break
        i, tag = min(cands)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(gen if tag == "{gen}" else comp)
        rest = rest[i + len(tag):]
    return F.concat(*parts)


def judge_prompts(df: DataFrame, reply: str = "reply", source: str = "final_prompt_en",
                  task_id: str = "nat_instr_id", keys=("row_id",)) -> DataFrame:
    """C11 + U4: three rubric prompts per row, one row each: (*keys, k, criterion, prompt); ``keys`` name the judged
    row, its model and mode when several runs are judged together.

    Blanks around the pasted texts differ by kind and criterion as in ``fixed.JUDGE_BLANKS``. Rows of kind ``other`` get
    NULL prompts (the original fails on them)."""
    gen, comp = judge_kind(task_id)
    r, s = F.col(reply), F.col(source)
    one = _fill(fixed.JUDGE_INTRO_ONE, gen, comp)
    two = _fill(fixed.JUDGE_INTRO_TWO, gen, comp)
    head_one = F.concat(one, F.lit("\n\n"), gen, F.lit(": \n"), r, F.lit(" \n\n "))

    def head_two(kind: str, criterion: str) -> Column:
        before, after = fixed.JUDGE_BLANKS[kind, criterion]
        return F.concat(two, F.lit(f"\n\n{before}"), gen, F.lit(f": \n{after}"), r, F.lit(" \n\n "), comp, F.lit(": \n "), s, F.lit(" \n\n "))

    rubric = {
        ("article", "coherence"): fixed.JUDGE_COHERENCE_ARTICLE, ("article", "relevance"): fixed.JUDGE_RELEVANCE,
        ("closing", "coherence"): fixed.JUDGE_COHERENCE_STORY, ("closing", "relevance"): fixed.JUDGE_RELEVANCE_STORY,
        ("paraphrased", "coherence"): fixed.JUDGE_COHERENCE_PARAPHRASE, ("paraphrased", "relevance"): fixed.JUDGE_RELEVANCE,
    }

    def pasted(criterion: str) -> Column:
        out = F.lit(None).cast("string")
        for kind in ("paraphrased", "closing", "article"):
            out = F.when(gen.contains(kind), F.concat(head_two(kind, criterion), _fill(rubric[kind, criterion], gen, comp))).otherwise(out)
        return out

    prompts = F.array(
        F.when(gen != "other", F.concat(head_one, _fill(fixed.JUDGE_FLUENCY, gen, comp))), pasted("coherence"), pasted("relevance"),
    )
    criteria = F.array(*[F.lit(c) for c in fixed.JUDGE_CRITERIA])
    return df.select(
        *keys, F.posexplode(F.arrays_zip(criteria.alias("criterion"), prompts.alias("prompt"))).alias("k", "z")
    ).select(*keys, "k", F.col("z.criterion").alias("criterion"), F.col("z.prompt").alias("prompt"))


def judge_messages(prompts: DataFrame, system: str = fixed.JUDGE_SYSTEM) -> DataFrame:
    """The two-message chat of each judge prompt; NULL for a NULL prompt, which is not sent."""
    messages = chat(msg("system", F.lit(system)), msg("user", F.col("prompt")))
    return prompts.withColumn("messages", F.when(F.col("prompt").isNotNull(), messages))


def regroup_judgements(answers: DataFrame, keys=("row_id",)) -> DataFrame:
    """Three answers (criterion, answer) per judged row (``keys``) -> one row with ``fluency``, ``coherence``, ``relevance``
    (whitespace-stripped text). A row without exactly one answer per criterion fails the job (raise_error inside
    the plan, no extra pass)."""
    wide = answers.groupBy(*keys).pivot("criterion", list(fixed.JUDGE_CRITERIA)).agg(
        F.first(text.strip_ws("answer")).alias("a"), F.count(F.lit(1)).alias("n")
    )
    ok = F.lit(True)
    for c in fixed.JUDGE_CRITERIA:
        ok = ok & (F.coalesce(F.col(f"{c}_n"), F.lit(0)) == 1)
    guard = F.when(~ok, F.raise_error(F.lit("Mismatch between number of rows and responses generated.")))
    return wide.select(
        *keys, *[F.coalesce(guard.cast("string"), F.col(f"{c}_a")).alias(c) for c in fixed.JUDGE_CRITERIA]
    )
