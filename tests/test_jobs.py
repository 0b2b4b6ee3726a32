"""The queue of analyses, and demands that are worked off once."""

from ripplegraph.operators.resolver import Demand
from ripplegraph.streaming.jobs import JobQueue


def test_jobs_run_in_order_and_fail_after_two_retries(spark, tmp_path):
    queue = JobQueue(spark, f"file://{tmp_path}/jobs")
    jobs = lambda *ids: spark.createDataFrame([(i, f"p{i}") for i in ids], "job_id string, payload string")
    queue.submit(jobs("b", "a", "a"))
    queue.submit(jobs("a", "c"))
    log = []

    def handler(job_id, payload):
        log.append(job_id)
        assert payload == f"p{job_id}"
        if job_id == "b" or job_id == "c" and log.count("c") < 2:
            raise ValueError("no")

    while queue.work(handler, most=2):
        pass
    assert sorted(log) == ["a", "b", "b", "b", "c", "c"] and log[:2] == ["a", "b"]
    rows = {r["job_id"]: (r["status"], r["attempts"], r["error"]) for r in queue.rows().collect()}
    assert rows == {"a": ("done", 1, None), "b": ("failed", 3, "ValueError: no"), "c": ("done", 2, None)}


def test_a_demand_is_resolved_once():
    asked = []
    demand = Demand(lambda todo: asked.append(todo))
    state = {"complete": False}

    def lookup():
        return "rows", state["complete"]

    assert demand.answer(lookup, [("symbol", "f")]) == ("rows", True) and asked == [[("symbol", "f")]]
    assert demand.answer(lookup, [("symbol", "f")]) == ("rows", True) and len(asked) == 1
    assert demand.answer(lookup, [("symbol", "f"), ("file", "x")]) == ("rows", True) and asked[1] == [("file", "x")]
    state["complete"] = True
    assert demand.answer(lookup, [("event", "1")]) == ("rows", True) and len(asked) == 2
