"""Agent worlds, one per group: sequential inside a world, parallel across worlds.

A world has 20 agents and runs 30 ticks of six phases (propose, start and
invite, accept or merge, exit, revise, complete).  Worlds of one seed share
their random numbers by key, so policies and networks differ only by what they
decide; every event is a row, and journal.commit() chains them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidmill.operators.effects import keyed_random

EVENTS = "branch string, seed int, policy string, network string, seq bigint, tick int, kind string, agent int, project int, units int, value double, payload string"
#: Energy and effort of the actions, exit options and temperature of the published model.
EFFORT = {"topic": 1, "invite": 3, "propose": 20, "revise": 10, "complete": 4, "exit": 2}
AGENTS, TICKS, TEMPERATURE, STRENGTH = 20, 30, 0.2, 0.5
WEIGHTS = {"balanced": (0.5, 0.5), "novelty": (1.0, 0.0), "recognition": (0.0, 1.0)}


def clip(x: float) -> float:
    return max(0.0, min(1.0, x))


def choose(options: list[tuple[str, float]], u: float) -> str:
    """The option, by softmax over utilities in order of name, at which the cumulative probability passes u."""
    options = sorted(options)
    top = max(x for _, x in options)
    e = [math.exp((x - top) / TEMPERATURE) for _, x in options]
    run, total = 0.0, sum(e)
    for (name, _), w in zip(options, e):
        run += w / total
        if u < run:
            return name
    return options[-1][0]


def world(seed: int, policy: str, network: str, ticks: int = TICKS) -> list[dict]:
    wn, wr = WEIGHTS[policy]
    out: list[dict] = []
    draw = lambda *k: keyed_random(seed, *k).random()
    agents = [{"id": a, "field": a % 3, "rep": draw("rep", a), "energy": 100, "coop": draw("coop", a), "risk": draw("risk", a), "project": None, "topics": {a % 12}} for a in range(AGENTS)]
    projects: dict[int, dict] = {}

    def event(tick: int, kind: str, agent: int, project: int | None, units: int = 0, value: float = 0.0) -> None:
        out.append({"tick": tick, "kind": kind, "agent": agent, "project": -1 if project is None else project, "units": units, "value": round(value, 9)})

    def policy_part(novelty: float, recognition: float) -> float:
        return STRENGTH * (wn * novelty + wr * recognition)

    for tick in range(ticks):
        cycle, phase = divmod(tick, 6)
        for a in agents:
            a["energy"] = min(100, a["energy"] + 8)
        for a in agents:
            free = a["project"] is None
            if phase == 0 and free:
                options = []
                for t in range(12):
                    nov, att = (0.2 if t in a["topics"] else 0.8), (t % 5 + 1) / 5
                    options.append((f"{t:02d}", 0.6 * (1 if t % 3 == a["field"] else 0.4) + 0.4 * (1 - nov) + policy_part(nov, att)))
                topic = int(choose(options, draw("topic", cycle, a["id"])))
                a["topics"].add(topic)
                if draw("evidence", cycle, a["id"]) < 0.1:
                    a["energy"] -= 4
                    event(tick, "shortfall", a["id"], None)
                    continue
                a["energy"] -= 20
                p = len(projects)
                projects[p] = {"id": p, "owner": a["id"], "members": [a["id"]], "status": "active", "topic": topic, "novelty": draw("novelty", cycle, a["id"]), "into": None, "quality": draw("quality", cycle, a["id"])}
                a["project"] = p
                event(tick, "propose", a["id"], p, EFFORT["propose"], projects[p]["novelty"])
            elif phase == 1 and not free and projects[a["project"]]["owner"] == a["id"] and a["id"] % 2 == cycle % 2:
                others = [b for b in agents if b["project"] is not None and b["project"] != a["project"] and projects[b["project"]]["owner"] == b["id"] and (network == "open" or b["field"] == a["field"])]
                options = [("decline", 0.3)]
                # the cycle's candidates: the first eight by hash, so any agent may be offered
                others.sort(key=lambda b: draw("offer", cycle, a["id"], b["id"]))
                for b in others[:8]:
                    match = float(projects[b["project"]]["topic"] == projects[a["project"]]["topic"])
                    options.append((f"{b['id']:02d}", 0.35 * 0.5 + 0.35 * match + 0.3 * b["rep"] + policy_part(0.5 * match, 0.5 * b["rep"]) - 0.25 * 0.5))
                picked = choose(options, draw("invite", cycle, a["id"]))
                if picked != "decline":
                    projects[a["project"]]["invited"] = int(picked)
                    event(tick, "invite", a["id"], a["project"], EFFORT["invite"], float(picked))
            elif phase == 2 and not free and projects[a["project"]]["owner"] == a["id"]:
                guest = projects[a["project"]].pop("invited", None)
                if guest is None:
                    continue
                b = agents[guest]
                if b["project"] is None or b["project"] == a["project"] or projects[b["project"]]["owner"] != guest or projects[b["project"]]["status"] != "active":
                    continue
                accept = 0.25 + 0.5 * b["coop"] + policy_part(0.5, 0.5 * a["rep"]) - 0.15
                if choose([("accept", accept), ("wait", 0.3)], draw("accept", cycle, guest)) == "accept":
                    old = projects[b["project"]]
                    old["status"], old["into"] = "merged", a["project"]
                    for m in old["members"]:
                        agents[m]["project"] = a["project"]
                        projects[a["project"]]["members"].append(m)
                    event(tick, "merge", guest, old["id"], 0, float(a["project"]))
            elif phase == 3 and not free:
                p = projects[a["project"]]
                stay = 0.5 * p["quality"] + 0.5 * a["rep"] + policy_part(p["novelty"], a["rep"]) - 0.22
                if choose([("continue", stay), ("exit", 0.35 - 0.08)], draw("exit", cycle, a["id"])) == "exit":
                    p["members"].remove(a["id"])
                    event(tick, "exit", a["id"], p["id"], EFFORT["exit"])
                    a["project"] = None
                    if not p["members"]:
                        p["status"] = "abandoned"
                        event(tick, "abandon", a["id"], p["id"])
                    elif p["owner"] == a["id"]:
                        p["owner"] = min(p["members"], key=lambda m: (-agents[m]["rep"], m))
            elif phase == 4 and not free:
                a["energy"] -= 10
                event(tick, "revise", a["id"], a["project"], EFFORT["revise"])
            elif phase == 5 and not free and projects[a["project"]]["owner"] == a["id"]:
                p = projects[a["project"]]
                p["status"] = "completed"
                reward = wn * p["novelty"] + wr * (p["topic"] % 5 + 1) / 5
                event(tick, "complete", a["id"], p["id"], EFFORT["complete"], reward)
                for m in p["members"]:
                    agents[m]["rep"] = clip(agents[m]["rep"] + 0.05 * (reward - 0.5))
                for m in p["members"]:
                    agents[m]["project"] = None
    for p in projects.values():
        if p["status"] == "active":
            event(ticks, "censor", p["owner"], p["id"])
    return out


def simulate(branches: DataFrame, ticks: int = TICKS) -> DataFrame:
    """Event rows of every (seed, policy, network)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, policy, network = int(pdf["seed"].iloc[0]), pdf["policy"].iloc[0], pdf["network"].iloc[0]
        rows = pd.DataFrame(world(seed, policy, network, ticks))
        rows.insert(0, "seq", range(len(rows)))
        branch = f"seed={seed}/policy={policy}/network={network}"
        rows = rows.assign(branch=branch, seed=seed, policy=policy, network=network)
        rows["payload"] = [f"{r.tick}:{r.kind}:{r.agent}:{r.project}:{r.units}:{r.value}" for r in rows.itertuples()]
        return rows[[c.split()[0] for c in EVENTS.split(", ")]]

    return branches.groupBy("seed", "policy", "network").applyInPandas(one, EVENTS)


def flow(events: DataFrame) -> DataFrame:
    """Per branch: started, merged, abandoned, completed, censored projects, effort, and the residual of their conservation (0)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    g = events.groupBy("seed", "policy", "network").agg(n("propose").alias("started"), n("merge").alias("merged"), n("abandon").alias("abandoned"), n("complete").alias("completed"), n("censor").alias("censored"), F.sum("units").alias("effort"))
    return g.withColumn("residual", F.col("started") - F.col("merged") - F.col("abandoned") - F.col("completed") - F.col("censored"))
