"""Step reward as columns over a step table (RW1-RW13).

All components are Column expressions; ``with_step_reward`` adds them to any
DataFrame that carries the step inputs, so rewarding a billion steps is one
narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryforge.functions import scalar as S
from queryforge.functions import text as X

# --- fixed values: reward weights and tiers ---
CORRECTNESS_WEIGHT = 0.6
SYNTAX_INSPECT = 0.01
SCHEMA_WEIGHT = 0.1
SUCCESS_GRADE = 0.95
REGRESSION_MARGIN = 0.1
REGRESSION_PENALTY = 0.05
RESET_PENALTY = 0.05
URGENCY_PENALTY = 0.03
URGENCY_STEPS = 2
URGENCY_GRADE = 0.5
INSPECT_ACTIONS = ("inspect_schema", "inspect_error", "inspect_sample")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reward_columns(action="action_type", grade="grade_used", success="success", error="error_message",
                   query="query", tables="tables", step="step", max_steps="max_steps",
                   prev_best="prev_best", totals: bool = True) -> dict[str, Column]:
    """RW1-RW10 as named Columns.

    ``grade`` is the grade entering the rules: the submit's own grade, or the
    best score so far for other actions.  ``prev_best`` is the best score before
    this step.
    """
    a, g = _c(action), F.coalesce(_c(grade), F.lit(0.001))  # an ungraded step counts as the lowest grade
    submit = a == "submit_query"
    zero = F.lit(0.0)
    correctness = F.when(submit, F.least(F.lit(CORRECTNESS_WEIGHT), g * F.lit(CORRECTNESS_WEIGHT))).otherwise(zero)
    syntax = (F.when(submit, X.error_progress(_c(success), _c(error)))
              .when(a.isin(*INSPECT_ACTIONS), F.lit(SYNTAX_INSPECT)).otherwise(zero))
    n_tables = F.size(_c(tables))
    has_query = _c(query).isNotNull() & (F.length(_c(query)) > 0)
    schema = F.when(submit & has_query & (n_tables > 0),
                    F.least(F.lit(SCHEMA_WEIGHT),
                            X.table_ref_count(_c(query), _c(tables)) / n_tables * F.lit(SCHEMA_WEIGHT))
                    ).otherwise(zero)
    efficiency = F.when(submit & (g >= F.lit(SUCCESS_GRADE)), S.step_fraction_tier(step, max_steps)).otherwise(zero)
    base_pen = (F.when(submit & (g < _c(prev_best) - F.lit(REGRESSION_MARGIN)), F.lit(REGRESSION_PENALTY))
                .when(a == "reset_query", F.lit(RESET_PENALTY)).otherwise(zero))
    urgency = F.when(((_c(max_steps) - _c(step)) <= URGENCY_STEPS) & (g < F.lit(URGENCY_GRADE)),
                     F.lit(URGENCY_PENALTY)).otherwise(zero)
    penalty = base_pen + urgency
    parts = {"correctness": correctness, "efficiency": efficiency, "syntax_progress": syntax,
             "schema_bonus": schema, "penalty": penalty}
    if not totals:
        return parts
    total = S.clamp_round(correctness + efficiency + syntax + schema - penalty, digits=S.REWARD_DIGITS)
    breakdown = F.format_string(
        "correctness=%s + efficiency=%s + syntax=%s + schema=%s + penalty=%s = %s",
        S.py_fixed(correctness, 3), S.py_fixed(efficiency, 3), S.py_fixed(syntax, 3), S.py_fixed(schema, 3),
        S.py_fixed(penalty, 3), S.py_fixed(total, 4))
    return {"correctness": correctness, "efficiency": efficiency, "syntax_progress": syntax,
            "schema_bonus": schema, "penalty": penalty, "reward": total, "breakdown": breakdown}


def with_step_reward(df: DataFrame, **cols) -> DataFrame:
    """Add correctness, efficiency, syntax_progress, schema_bonus, penalty, reward, breakdown.

    Components are projected first and the total and its text read them by
    name, so the (non-trivial) component expressions are evaluated once.
    """
    rc = reward_columns(**cols, totals=False)
    parts = list(rc)
    out = df.withColumns(rc)
    c = {k: F.col(k) for k in parts}
    total = S.clamp_round(c["correctness"] + c["efficiency"] + c["syntax_progress"] + c["schema_bonus"]
                          - c["penalty"], digits=S.REWARD_DIGITS)
    out = out.withColumn("reward", total)
    return out.withColumn("breakdown", F.format_string(
        "correctness=%s + efficiency=%s + syntax=%s + schema=%s + penalty=%s = %s",
        *[S.py_fixed(k, 3) for k in parts], S.py_fixed("reward", 4)))


def review_rejected_reward(approved) -> Column:
    """RW11: a submit rejected by review earns 0.001 and uses no step."""
    return F.when(~_c(approved), F.lit(S.MIN_SCORE))


def keyword_reward(text, jitter_seed: int | None = None) -> Column:
    """RW12: 1.0 when the text holds SELECT and ';' (case-blind), else 0.0; optional +-0.01 jitter."""
    base = F.when(X.has_keywords(text, ("SELECT", ";"), "all"), F.lit(1.0)).otherwise(F.lit(0.0))
    if jitter_seed is None:
        return base
    return base + S.jitter(jitter_seed, 0.01)


def keyword_hit(text, words=("SELECT", "FROM", "WHERE")) -> Column:
    """RW13: any of the words present (the lenient demo accuracy)."""
    return X.has_keywords(text, words, "any")
