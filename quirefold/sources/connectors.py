"""Calls of recognition services.  The transport is a parameter: a callable that sends one request and returns its reply.

Nothing here opens a connection by itself; ``replay`` gives recorded replies for tests and re-runs.  Calls run in Arrow batches, one at a
time per task, so the number of partitions is the rate limit.  A call that fails after its retries gives a row with the error
and the placeholder text of its pages; it stops no job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quirefold.operators.registry import CLIENT_PARAMETERS

Transport = Callable[[str, dict, dict], dict]
#: fixed values: retries, first delay (doubling)
RETRIES, FIRST_DELAY = 3, 5.0
REPLY_SCHEMA = "call_id bigint, text string, error string, attempts int"


def with_retries(send: Callable[[], dict], retries: int = RETRIES, delay: float = FIRST_DELAY, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, str | None, int]:
    """(reply, error, attempts); the delay doubles after each failure."""
    error = None
    for attempt in range(1, retries + 1):
        try:
            return send(), None, attempt
        except Exception as e:  # noqa: BLE001 - the last error is reported
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                sleep(delay)
                delay *= 2
    return None, error, retries


def message_content(prompt: str | None, images: list[str], provider: str, images_first: bool = False) -> list[dict]:
    """Blocks of one user message in the form of the provider."""
    if provider == "anthropic":
        parts = [{"type": "image", "source": {"type": "base64", "media_type": u[5:].split(";")[0], "data": u.split(",", 1)[1]}} for u in images]
    else:
        parts = [{"type": "image_url", "image_url": {"url": u}} for u in images]
    text = [{"type": "text", "text": prompt or ""}]
    return parts + text if images_first else text + parts


def headers(config: dict, key: str | None) -> dict:
    own = {"Content-Type": "application/json", **(config.get("headers") or {})}
    if not key:
        return own
    return own | ({"x-api-key": key} if config.get("content_format") == "anthropic" else {"Authorization": f"Bearer {key}"})


def body(config: dict, messages: list[dict]) -> dict:
    return {"model": config["model_id"], "messages": messages, **json.loads(config.get("payload_template") or "{}")}


def split_parameters(template: dict) -> tuple[dict, dict]:
    """Members that clients take as arguments, and the rest."""
    return {k: v for k, v in template.items() if k in CLIENT_PARAMETERS}, {k: v for k, v in template.items() if k not in CLIENT_PARAMETERS}


def reply_text(reply: dict) -> str:
    """Text of a whole reply in either form."""
    if "choices" in reply:
        return reply["choices"][0]["message"]["content"] or ""
    return "".join(part.get("text", "") for part in reply.get("content", []))


def call_model(batches: DataFrame, config: dict, transport: Transport, key: str | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Replies of one model.  ``batches`` has call_id, prompt, images (data URIs), placeholder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for call_id, prompt, images, placeholder in zip(frame["call_id"], frame["prompt"], frame["images"], frame["placeholder"]):
                messages = [{"role": "user", "content": message_content(prompt, list(images), config.get("content_format", "openai"))}]
                reply, error, attempts = with_retries(lambda: transport(config["api_url"], headers(config, key), body(config, messages)), sleep=sleep)
                rows.append((call_id, placeholder if reply is None else reply_text(reply), error, attempts))
            yield pd.DataFrame(rows, columns=["call_id", "text", "error", "attempts"])

    return batches.select("call_id", "prompt", "images", "placeholder").mapInPandas(run, REPLY_SCHEMA)


def poll(fetch: Callable[[], dict], interval: float = 5.0, timeout: float = 600.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> dict:
    """Last state of a job: done or failed, or ``timeout`` when its time is over.  Failed requests are tried again."""
    until = clock() + timeout
    last: dict = {"state": "pending"}
    while clock() < until:
        try:
            last = fetch()
        except Exception as e:  # noqa: BLE001 - transport errors of a poll are passing
            last = {"state": "unknown", "error": str(e)}
        if last.get("state") in ("done", "failed"):
            return last
        sleep(interval)
    return last | {"state": "timeout"}


def submit_and_fetch(submit: Callable[[], str], fetch_state: Callable[[str], dict], fetch_result: Callable[[dict], str], **options) -> tuple[str | None, str | None]:
    """(result, error) of one asynchronous job: submit, poll to the end, fetch."""
    job = submit()
    state = poll(lambda: fetch_state(job), **options)
    if state["state"] != "done":
        return None, state.get("error") or state["state"]
    return fetch_result(state), None


def submit_request(config: dict, path: str, options: dict) -> dict:
    """What a page service takes: a JSON body for an address, form fields for a file, whose options are a JSON string."""
    common = {"model": config["model_id"]}
    if path.startswith("http"):
        return {"json": {"fileUrl": path, **common, "optionalPayload": options}}
    return {"form": {**common, "optionalPayload": json.dumps(options)}, "file": path}


def job_of(reply: dict) -> str:
    """Job number of a submission in either form; an error code raises."""
    if reply.get("code", 0) != 0:
        raise RuntimeError(reply.get("msg") or f"code {reply['code']}")
    data = reply["data"]
    return data["jobId"] if "jobId" in data else data["batch_id"]


def state_of_reply(reply: dict) -> dict:
    """(state, pages, done_pages, url, error) of a poll in either form; states between are ``running``."""
    if reply.get("code", 0) != 0:
        return {"state": "failed", "error": reply.get("msg") or f"code {reply['code']}"}
    data = reply.get("data") or {}
    if "extract_result" in data:
        data = (data["extract_result"] or [{}])[0]
    progress = data.get("extractProgress") or data.get("extract_progress") or {}
    state = str(data.get("state") or "unknown").strip().lower()
    return {
        "state": state if state in ("done", "failed") else "running",
        "pages": progress.get("totalPages", progress.get("total_pages")),
        "done_pages": progress.get("extractedPages", progress.get("extracted_pages")),
        "url": (data.get("resultUrl") or {}).get("jsonUrl") or data.get("full_zip_url"),
        "error": data.get("errorMsg") or data.get("err_msg"),
    }


#: fixed values: how the result of each kind of service is read
RESULT_FORMS = {"paddleocr_async": "layout lines", "pp-ocrv6": "text lines", "mineru_async": "archive", "openai": "chat", "anthropic": "chat"}


def result_form(config: dict) -> str:
    """Which reader of ``sources`` takes the result of a model; unknown kinds are an error."""
    kind = config.get("content_format", "openai")
    if kind not in RESULT_FORMS:
        raise ValueError(f"no service of the kind {kind!r}")
    return RESULT_FORMS[kind]


def replay(replies: list[dict | Exception]) -> Transport:
    """A transport that gives recorded replies in turn and raises recorded errors."""
    left = list(replies)

    def send(_url: str, _headers: dict, _body: dict) -> dict:
        reply = left.pop(0) if len(left) > 1 else left[0]
        if isinstance(reply, Exception):
            raise reply
        return reply

    return send
