"""Task catalog and the four small task databases (SRC4, UD2, GR7 fixtures).

The catalog is a small dimension created in code, one row for each registered task,
so broadcasting it is safe by construction.  Queries are written in Spark SQL (they run
on Spark); the "broken" forms keep the kind of bug each task is about.

UD2: a task is a ``Task``.  ``register_task`` adds one; the catalog, the episode folds
(budget, hint rule, broken query) and ``grade_for_task`` (golden rows, grader) then
know it like the four built-in ones.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: task ids, step budgets, hint steps, success thresholds ---
TASK_IDS = ("easy_syntax_fix", "medium_logic_fix", "hard_multi_bug", "hard_finance_explosion")
DIFFICULTY = {"easy_syntax_fix": "easy", "medium_logic_fix": "medium",
              "hard_multi_bug": "hard", "hard_finance_explosion": "expert"}
MAX_STEPS = {"easy_syntax_fix": 10, "medium_logic_fix": 20, "hard_multi_bug": 30,
             "hard_finance_explosion": 12}
SUCCESS_THRESHOLD = {"easy_syntax_fix": 0.8, "medium_logic_fix": 0.7, "hard_multi_bug": 0.5,
                     "hard_finance_explosion": 0.5}
TASK_TABLES = {
    "easy_syntax_fix": ["customers", "order_items", "orders"],
    "medium_logic_fix": ["departments", "employees"],
    "hard_multi_bug": ["purchases", "users"],
    "hard_finance_explosion": ["orders", "payments", "users"],
}
GRADER = {"easy_syntax_fix": "positional", "medium_logic_fix": "sorted_tolerant",
          "hard_multi_bug": "positional", "hard_finance_explosion": "keyed_tiers"}
LONGEST_EPISODE = max(MAX_STEPS.values())

# --- fixed values: task texts (names, descriptions, broken and repaired SQL, hints) ---
_TEXT = {
    "easy_syntax_fix": dict(
        name="Top customers by revenue (syntax repair)",
        description=("Find the five customers with the largest total order value, the sum of "
                     "quantity times unit price over all their order items. The query has a "
                     "misspelt keyword and an ORDER BY on an alias that does not exist."),
        expected="5 rows: customer_name, total_value, largest first.",
        broken=("SELECT c.name AS customer_name, ROUND(SUM(oi.quantity * oi.unit_price), 2) AS total_value "
                "FROM customers c JOIN orders o ON c.id = o.customer_id "
                "JOIN order_items oi ON o.id = oi.order_id GRUP BY c.id, c.name ORDER BY total DESC LIMIT 5"),
        fixed=("SELECT c.name AS customer_name, ROUND(SUM(oi.quantity * oi.unit_price), 2) AS total_value "
               "FROM customers c JOIN orders o ON c.id = o.customer_id "
               "JOIN order_items oi ON o.id = oi.order_id GROUP BY c.id, c.name "
               "ORDER BY total_value DESC, c.id LIMIT 5"),
        hint="Check keyword spelling, and order by the alias the select list defines."),
    "medium_logic_fix": dict(
        name="Department hires in 2023 (join logic repair)",
        description=("Per department: number of employees hired in 2023 and their average salary. "
                     "Departments without 2023 hires must stay in the result with count 0."),
        expected="4 rows, one per department, ordered by name; Legal has headcount 0.",
        broken=("SELECT d.name AS department_name, COUNT(e.id) AS headcount, "
                "ROUND(AVG(e.salary), 2) AS avg_salary FROM departments d "
                "JOIN employees e ON d.id = e.department_id WHERE year(e.hire_date) = 2023 "
                "GROUP BY d.name ORDER BY department_name ASC"),
        fixed=("SELECT d.name AS department_name, COUNT(e.id) AS headcount, "
               "ROUND(AVG(e.salary), 2) AS avg_salary FROM departments d "
               "LEFT JOIN employees e ON d.id = e.department_id "
               "AND e.hire_date >= DATE'2023-01-01' AND e.hire_date < DATE'2024-01-01' "
               "GROUP BY d.id, d.name ORDER BY department_name ASC"),
        hint="Keep every department: move the year condition into the outer join."),
    "hard_multi_bug": dict(
        name="Cohort activation (multi-bug repair)",
        description=("Users who signed up in Q1 2023 and made at least two purchases within 30 days "
                     "of signup, with first purchase date, days to it, purchases in the window and "
                     "lifetime value, largest lifetime value first."),
        expected="2 rows, ordered by total_lifetime_value descending.",
        broken=("WITH q1_users AS (SELECT DISTINCT u.id, u.username, u.signup_date FROM users u "
                "JOIN purchases p ON u.id = p.user_id WHERE u.signup_date >= DATE'2023-01-01' "
                "AND u.signup_date <= DATE'2023-03-31' AND p.purchase_date <= DATE'2023-03-31'), "
                "stats AS (SELECT q.id AS user_id, q.username, q.signup_date, "
                "(SELECT MIN(purchase_date) FROM purchases WHERE amount > 0) AS first_purchase_date, "
                "COUNT(*) AS purchases_in_first_30_days, "
                "SUM(SUM(p.amount)) OVER (PARTITION BY q.id) AS total_lifetime_value "
                "FROM q1_users q JOIN purchases p ON q.id = p.user_id "
                "WHERE datediff(p.purchase_date, q.signup_date) <= 30 "
                "GROUP BY q.id, q.username, q.signup_date) "
                "SELECT user_id, username, signup_date, first_purchase_date, "
                "CAST(datediff(signup_date, first_purchase_date) AS INT) AS days_to_first_purchase, "
                "purchases_in_first_30_days, ROUND(total_lifetime_value, 2) AS total_lifetime_value "
                "FROM stats WHERE purchases_in_first_30_days >= 2 ORDER BY total_lifetime_value DESC"),
        fixed=("WITH q1_users AS (SELECT u.id, u.username, u.signup_date FROM users u "
               "WHERE u.signup_date >= DATE'2023-01-01' AND u.signup_date <= DATE'2023-03-31'), "
               "stats AS (SELECT q.id AS user_id, q.username, q.signup_date, "
               "MIN(p.purchase_date) AS first_purchase_date, "
               "COUNT_IF(datediff(p.purchase_date, q.signup_date) BETWEEN 0 AND 30) AS purchases_in_first_30_days, "
               "SUM(p.amount) AS total_lifetime_value "
               "FROM q1_users q JOIN purchases p ON q.id = p.user_id AND p.amount > 0 "
               "GROUP BY q.id, q.username, q.signup_date) "
               "SELECT user_id, username, CAST(signup_date AS STRING) AS signup_date, "
               "CAST(first_purchase_date AS STRING) AS first_purchase_date, "
               "CAST(datediff(first_purchase_date, signup_date) AS INT) AS days_to_first_purchase, "
               "purchases_in_first_30_days, ROUND(total_lifetime_value, 2) AS total_lifetime_value "
               "FROM stats WHERE purchases_in_first_30_days >= 2 ORDER BY total_lifetime_value DESC"),
        hint="Correlate the first-purchase lookup, bound the window from signup, count each purchase once."),
    "hard_finance_explosion": dict(
        name="Fan-trap repair in financial totals",
        description=("Total order amount and total payment amount per user. Joining both child tables "
                     "at once multiplies rows; aggregate each child by user first, then join."),
        expected="name, total_orders, total_payments; one row per user.",
        broken=("SELECT u.name, SUM(o.order_amount) AS total_orders, SUM(p.payment_amount) AS total_payments "
                "FROM users u LEFT JOIN orders o ON u.user_id = o.user_id "
                "LEFT JOIN payments p ON u.user_id = p.user_id GROUP BY u.name ORDER BY u.name"),
        fixed=("WITH o AS (SELECT user_id, SUM(order_amount) AS total_orders FROM orders GROUP BY user_id), "
               "p AS (SELECT user_id, SUM(payment_amount) AS total_payments FROM payments GROUP BY user_id) "
               "SELECT u.name, o.total_orders, p.total_payments FROM users u "
               "LEFT JOIN o ON u.user_id = o.user_id LEFT JOIN p ON u.user_id = p.user_id ORDER BY u.name"),
        hint="Aggregate orders and payments per user separately, then join the totals to users."),
}

CATALOG_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("difficulty", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("expected_output_description", T.StringType(), False),
    T.StructField("broken_query", T.StringType(), False),
    T.StructField("fixed_query", T.StringType(), False),
    T.StructField("max_steps", T.IntegerType(), False),
    T.StructField("hint", T.StringType(), False),
    T.StructField("hint_step", T.IntegerType(), False),
    T.StructField("success_threshold", T.DoubleType(), False),
    T.StructField("tables", T.ArrayType(T.StringType(), False), False),
    T.StructField("grader", T.StringType(), False),
])


def _default_hint_step(difficulty: str) -> int:
    return 3 if difficulty == "easy" else 5


@dataclass(frozen=True)
class Task:
    """UD2: all that a task brings along.

    ``golden(spark)`` gives the expected rows in their order (default: ``fixed_query`` run on the tables at hand).  ``grader`` is a
    name in ``operators.grading.GRADERS`` or a function ``(actual, expected, attempt_keys, value_cols, grading, attempt_index) ->
    DataFrame`` with ``attempt_keys`` and ``score``; ``grading`` are the columns that it wants to know.  ``hint_step``: the first step
    that shows the hint (default: 3 for an easy task, 5 for others).
    """

    task_id: str
    name: str
    difficulty: str
    description: str
    expected_output_description: str
    broken_query: str
    fixed_query: str
    hint: str
    tables: tuple[str, ...]
    max_steps: int = 20
    hint_step: int | None = None
    success_threshold: float = 0.5
    grader: str | Callable[..., DataFrame] = "positional"
    grading: dict = field(default_factory=dict)
    golden: Callable[[SparkSession], DataFrame] | None = None

    def row(self) -> tuple:
        """The task's row of the catalog."""
        return (self.task_id, self.name, self.difficulty, self.description, self.expected_output_description, self.broken_query,
                self.fixed_query, self.max_steps, self.hint, _default_hint_step(self.difficulty) if self.hint_step is None else self.hint_step,
                self.success_threshold, list(self.tables), self.grader if isinstance(self.grader, str) else self.grader.__name__)


_GRADING = {"sorted_tolerant": {"key": "department_name", "count": "headcount", "value": "avg_salary"},
            "keyed_tiers": {"name": "name", "values": ["total_orders", "total_payments"]}}

TASKS: dict[str, Task] = {
    tid: Task(tid, _TEXT[tid]["name"], DIFFICULTY[tid], _TEXT[tid]["description"], _TEXT[tid]["expected"], _TEXT[tid]["broken"],
              _TEXT[tid]["fixed"], _TEXT[tid]["hint"], tuple(TASK_TABLES[tid]), MAX_STEPS[tid], None, SUCCESS_THRESHOLD[tid], GRADER[tid],
              _GRADING.get(GRADER[tid], {}))
    for tid in TASK_IDS}


def register_task(task: Task) -> None:
    """Add a task; its id must be new and its budget at least one step."""
    if task.task_id in TASKS:
        raise ValueError(f"task {task.task_id} is registered already")
    if task.max_steps < 1:
        raise ValueError(f"task {task.task_id} allows no step")
    TASKS[task.task_id] = task


def unregister_task(task_id: str) -> None:
    """Remove a task that was added; the built-in ones stay."""
    if task_id in TASK_IDS:
        raise ValueError(f"{task_id} is built in")
    del TASKS[task_id]


def task_rows() -> list[tuple]:
    return [task.row() for task in TASKS.values()]


def task_catalog(spark: SparkSession) -> DataFrame:
    """SRC4: the task dimension (a row for each registered task), meant to be broadcast.

    Built from literals (an inline VALUES table), so the optimizer sees a local
    relation of known size: no Python worker and no RDD behind it.
    """
    from queryforge.sources.tables import local_frame
    key = (id(spark), tuple(repr(r) for r in task_rows()))
    df = _CATALOG_CACHE.get(key)
    if df is None:
        df = local_frame(spark, task_rows(), CATALOG_SCHEMA)
        _CATALOG_CACHE[key] = df
    return df


_CATALOG_CACHE: dict[tuple, DataFrame] = {}


# --- fixed values: seed rows of the four small task databases ---
def _d(s: str) -> _dt.date:
    return _dt.date.fromisoformat(s)


def fixture_tables(spark: SparkSession, task_id: str) -> dict[str, DataFrame]:
    """The small database of one task as DataFrames (types per FIXTURES.md)."""
    mk = spark.createDataFrame
    if task_id == "easy_syntax_fix":
        customers = mk([
            (1, "Alice Chen", "alice@example.com", _d("2023-01-01")),
            (2, "Bob Kumar", "bob@example.com", _d("2023-01-05")),
            (3, "Carol White", "carol@example.com", _d("2023-01-10")),
            (4, "David Park", "david@example.com", _d("2023-02-01")),
            (5, "Eva Rodriguez", "eva@example.com", _d("2023-02-15")),
            (6, "Frank Liu", "frank@example.com", _d("2023-03-01")),
        ], "id long, name string, email string, created_at date")
        orders = mk([
            (1, 1, _d("2023-06-01"), "completed"), (2, 1, _d("2023-07-15"), "completed"),
            (3, 2, _d("2023-06-10"), "completed"), (4, 3, _d("2023-06-20"), "completed"),
            (5, 3, _d("2023-08-01"), "completed"), (6, 4, _d("2023-07-01"), "completed"),
            (7, 5, _d("2023-07-20"), "completed"), (8, 5, _d("2023-08-10"), "completed"),
            (9, 6, _d("2023-09-01"), "completed"),
        ], "id long, customer_id long, order_date date, status string")
        items = [
            (1, 1, "Laptop", 1, "1200.00"), (2, 1, "Mouse", 2, "25.00"), (3, 2, "Keyboard", 1, "150.00"),
            (4, 2, "Monitor", 1, "450.00"), (5, 2, "Webcam", 1, "97.50"), (6, 3, "Headphones", 1, "350.00"),
            (7, 3, "USB Hub", 2, "45.00"), (8, 4, "Tablet", 1, "600.00"), (9, 4, "Case", 1, "35.00"),
            (10, 5, "Charger", 2, "30.00"), (11, 5, "Cable", 3, "15.00"), (12, 6, "Desk Lamp", 1, "85.00"),
            (13, 6, "Chair Mat", 1, "60.00"), (14, 7, "Speakers", 1, "220.00"), (15, 7, "Microphone", 1, "180.00"),
            (16, 8, "Webcam", 1, "97.50"), (17, 9, "Monitor", 1, "450.00"),
        ]
        order_items = mk([(a, b, c, d, Decimal(e)) for a, b, c, d, e in items],
                         "id long, order_id long, product_name string, quantity long, unit_price decimal(18,2)")
        return {"customers": customers, "orders": orders, "order_items": order_items}
    if task_id == "medium_logic_fix":
        departments = mk([(1, "Engineering", 500000.0), (2, "Marketing", 200000.0),
                          (3, "Sales", 300000.0), (4, "Legal", 150000.0)],
                         "id long, name string, budget double")
        employees = mk([
            (1, "Ana Lima", 1, 95000.0, _d("2023-03-15")), (2, "Ben Sharma", 1, 102000.0, _d("2023-06-01")),
            (3, "Chris Wang", 1, 88000.0, _d("2022-01-10")), (4, "Diana Patel", 2, 72000.0, _d("2023-04-20")),
            (5, "Erik Johnson", 2, 68000.0, _d("2022-11-05")), (6, "Fatima Al-Hassan", 3, 55000.0, _d("2023-01-08")),
            (7, "George Okafor", 3, 61000.0, _d("2023-07-22")), (8, "Hannah Kim", 3, 58000.0, _d("2022-05-30")),
            (9, "Ivan Petrov", 1, 91000.0, _d("2022-08-14")),
        ], "id long, name string, department_id long, salary double, hire_date date")
        return {"departments": departments, "employees": employees}
    if task_id == "hard_multi_bug":
        users = mk([
            (1, "maya_torres", "maya@ex.com", _d("2023-01-15"), "pro"),
            (2, "james_osei", "james@ex.com", _d("2023-02-10"), "pro"),
            (3, "sophie_liang", "sophie@ex.com", _d("2023-03-05"), "free"),
            (4, "raj_mehta", "raj@ex.com", _d("2023-06-01"), "free"),
            (5, "anna_kovacs", "anna@ex.com", _d("2022-12-20"), "pro"),
        ], "id long, username string, email string, signup_date date, plan string")
        purchases = mk([
            (1, 1, "Pro Plan", 99.0, _d("2023-01-20")), (2, 1, "Add-on Pack", 29.0, _d("2023-02-02")),
            (3, 1, "Pro Renewal", 99.0, _d("2023-04-15")), (4, 1, "Consulting", 150.0, _d("2023-07-01")),
            (5, 2, "Starter Plan", 49.0, _d("2023-02-13")), (6, 2, "Storage Add-on", 19.0, _d("2023-03-07")),
            (7, 2, "Starter Renewal", 49.0, _d("2023-05-10")), (8, 3, "Free Trial Upgrade", 9.0, _d("2023-03-10")),
            (9, 3, "Pro Plan", 99.0, _d("2023-04-20")), (10, 4, "Starter Plan", 49.0, _d("2023-06-05")),
            (11, 4, "Add-on", 19.0, _d("2023-06-10")), (12, 5, "Pro Plan", 99.0, _d("2023-01-01")),
            (13, 5, "Consulting", 150.0, _d("2023-03-15")),
        ], "id long, user_id long, product_name string, amount double, purchase_date date")
        return {"users": users, "purchases": purchases}
    if task_id == "hard_finance_explosion":
        users = mk([(1, "Alice"), (2, "Bob")], "user_id long, name string")
        orders = mk([(101, 1, Decimal("100.00")), (102, 1, Decimal("100.00")), (103, 1, Decimal("100.00")),
                     (104, 2, Decimal("50.00"))], "order_id long, user_id long, order_amount decimal(10,2)")
        payments = mk([(201, 1, Decimal("100.00")), (202, 1, Decimal("100.00")), (203, 1, Decimal("100.00")),
                       (204, 2, Decimal("50.00"))], "payment_id long, user_id long, payment_amount decimal(10,2)")
        return {"users": users, "orders": orders, "payments": payments}
    raise KeyError(task_id)


# Literal golden rows as printed by the source tasks; the easy one is known to be
# wrong (third row), so grading uses ``golden_rows`` computed from the seed rows.
LITERAL_EASY_GOLDEN = [("Alice Chen", 1947.50), ("Carol White", 740.00), ("Frank Liu", 595.00),
                       ("Eva Rodriguez", 497.50), ("Bob Kumar", 440.00)]


def golden_rows(spark: SparkSession, task_id: str) -> DataFrame:
    """GR7: expected rows of a task: its own ``golden``, or its fixed query, for the built-in tasks on their fixture."""
    task = TASKS[task_id]
    if task.golden is not None:
        return task.golden(spark)
    if task_id in TASK_IDS:
        for name, df in fixture_tables(spark, task_id).items():
            df.createOrReplaceTempView(name)
    return spark.sql(task.fixed_query)
