"""Workflows over rows: a fold over steps whose state, a map of variables among it, is a column.

A workflow is a list of steps {"id", "action", "condition"?, "on_error"?}.  Its state is the variables, the effects so
far and the error that stops it.  Each row runs the whole workflow; what a desktop would do (run a command, open a file,
copy, notify, send a request, wait) is returned as effects, with ${name} resolved at that moment.

Actions: SetVariable {name, value}; If {condition, then_steps, else_steps?}; Loop {count?, condition?, steps}; and the
effects ExecuteCommand {command, args}, OpenFile {path}, CopyToClipboard {content}, ShowNotification {title, message},
HttpRequest {method, url, body?}, Delay {milliseconds}.  Any other action is an error, as is a method that requests don't
have.  A loop with a count stops early where its condition no longer holds; one without a count runs while it holds, and
is in error after `most` rounds.

on_error, of the steps of the workflow itself: {"type": "Stop"} (as without it) ends the workflow; "Continue" goes on;
"Retry" {max_attempts} tries again and goes on, even if no attempt succeeds; "Fallback" {steps} runs other steps, whose
own errors end the workflow.  Effects of a failed attempt stay.

Steps within a step are lambda functions of the state, so a plan grows with the steps and not with the rounds of loops.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovex.operators.rules import condition, substituted

STATE = "struct<variables:map<string,string>,effects:array<struct<step:string,kind:string,detail:map<string,string>>>,error:string>"
METHODS = ("GET", "POST", "PUT", "DELETE")
#: Rounds of a loop without a count.
MOST = 1000
#: What is resolved of each action that has an effect.
DETAILS = {
    "ExecuteCommand": ("command", "args"), "OpenFile": ("path",), "CopyToClipboard": ("content",), "ShowNotification": ("title", "message"),
    "HttpRequest": ("method", "url", "body"), "Delay": ("milliseconds",),
}


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def state(variables: Column, effects: Column, error: Column) -> Column:
    return F.struct(variables.alias("variables"), effects.alias("effects"), error.alias("error")).cast(STATE)


def resolved(template: object, variables: Column) -> Column:
    """A template with its ${name} replaced by the variables that there are."""
    text = " ".join(map(str, template)) if isinstance(template, list) else str(template)
    return substituted(F.lit(text), variables, list(dict.fromkeys(re.findall(r"\$\{([^}]*)\}", text))))


def failed(s: Column, error: str) -> Column:
    return state(s["variables"], s["effects"], F.lit(error))


def acted(action: dict, step: str, s: Column, most: int) -> Column:
    """The state after an action."""
    kind = action["type"]
    if kind == "SetVariable":
        others = F.map_filter(s["variables"], lambda k, _: k != action["name"])
        return state(F.map_concat(others, F.create_map(F.lit(action["name"]), resolved(action["value"], s["variables"]))), s["effects"], s["error"])
    if kind == "If":
        return F.when(condition(action["condition"], s["variables"]), run_steps(action["then_steps"], s, most)).otherwise(run_steps(action.get("else_steps") or [], s, most))
    if kind == "Loop":
        count, test = action.get("count"), action.get("condition")
        rounds = count if count is not None else most if test else 0
        if not rounds:
            return s
        holds = lambda c: c["error"].isNull() & (condition(test, c["variables"]) if test else F.lit(True))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), s, lambda c, _: F.when(holds(c), run_steps(action["steps"], c, most)).otherwise(c))
        return end if count is not None else bound(end, lambda c: F.when(holds(c), failed(c, f"{step}: the loop does not end")).otherwise(c))
    if kind not in DETAILS:
        return failed(s, f"{step}: unsupported action {kind}")
    if kind == "HttpRequest" and action["method"] not in METHODS:
        return failed(s, f"{step}: unsupported method {action['method']}")
    detail = F.create_map(*[x for k in DETAILS[kind] if action.get(k) is not None for x in (F.lit(k), resolved(action[k], s["variables"]))])
    effect = F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), detail.alias("detail"))
    return state(s["variables"], F.concat(s["effects"], F.array(effect)), s["error"])


def run_step(step: dict, s: Column, most: int) -> Column:
    """The state after a step: as it was, where its condition does not hold or an error has stopped the workflow."""
    runs = s["error"].isNull()
    if step.get("condition"):
        runs = runs & condition(step["condition"], s["variables"])
    return F.when(runs, acted(step["action"], step["id"], s, most)).otherwise(s)


def run_steps(steps: list[dict], s: Column, most: int) -> Column:
    """The state after steps within a step."""

    def by(step: dict) -> Callable[[Column], Column]:  # Spark counts a lambda's arguments
        return lambda c: run_step(step, c, most)

    for step in steps:
        s = bound(s, by(step))
    return s


def handled(step: dict, s: Column, most: int) -> Column:
    """The state after a step of the workflow itself, once its errors are dealt with."""
    on_error = step.get("on_error") or {"type": "Stop"}
    before = s["error"].isNull()
    free = lambda c: state(c["variables"], c["effects"], F.lit(None))
    end = run_step(step, s, most)
    if on_error["type"] == "Continue":
        end = bound(end, free)
    elif on_error["type"] == "Retry":
        for _ in range(on_error["max_attempts"]):
            end = bound(end, lambda c: F.when(c["error"].isNotNull(), run_step(step, free(c), most)).otherwise(c))
        end = bound(end, free)
    elif on_error["type"] == "Fallback":
        end = bound(end, lambda c: F.when(c["error"].isNotNull(), run_steps(on_error["steps"], free(c), most)).otherwise(c))
    return F.when(before, end).otherwise(s)


def executed(rows: DataFrame, steps: list[dict], variables: Column, name: str = "run", most: int = MOST) -> DataFrame:
    """rows with a column struct(variables, effects, error) after a workflow; variables is the map it begins with.

    Each step of the workflow is a projection of its own, so long workflows are long plans and not deep ones.
    """
    rows = rows.withColumn(name, state(variables, F.array(), F.lit(None)))
    for step in steps:
        rows = rows.withColumn(name, handled(step, F.col(name), most))
    return rows


def effects(rows: DataFrame, run: str, *kept: str) -> DataFrame:
    """kept columns and (number, step, kind, detail), one row for each effect of a column of executed()."""
    return rows.select(*kept, F.posexplode(F.col(run)["effects"]).alias("number", "_effect")).select(*kept, "number", "_effect.step", "_effect.kind", "_effect.detail")
