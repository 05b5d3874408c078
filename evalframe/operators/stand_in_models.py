"""Deterministic stand-in models for tests and benchmarks.

They follow the predictor protocol of ``operators.infer`` —
``predict(messages, max_tokens=..., temperature=..., **options) -> str`` —
and answer from simple properties of their input, so the expected output of
a whole run can be written down in SQL. Real clients plug in the same way.
"""

from __future__ import annotations

from evalframe.operators.infer import user_text


def choice_model():
    """Answers "The answer is X", X = A..E picked by the user text's token count mod 5."""

    def predict(messages, **_):
        n = len(user_text(messages).split())
        return "The answer is " + chr(65 + n % 5)

    return predict


def parity_judge():
    """Grader: criterion met when the prompt has an even number of characters."""

    def predict(messages, **_):
        prompt = user_text(messages)
        if len(prompt) % 2 == 0:
            return '{"explanation": "even", "criteria_met": true}'
        return 'The response does not meet it.\n{"criteria_met": false}'

    return predict


class StatusError(Exception):
    """Client error carrying an HTTP-like status code."""

    def __init__(self, status_code: int, message: str = ""):
        super().__init__(message or f"status {status_code}")
        self.status_code = status_code


def flaky_choice_model():
    """Like ``choice_model`` but rate-limited (429) on the first call for token counts
    divisible by 5, and rejecting (400, not retryable) token counts divisible by 7.
    It recognises retries of the same call by identity, so use it with
    ``concurrency=1``."""
    current = [None]  # messages of the call being retried (kept alive, compared by identity)

    def predict(messages, **_):
        text = user_text(messages)
        n = len(text.split())
        if n % 7 == 0:
            raise StatusError(400, "bad request")
        first_attempt = current[0] is not messages
        current[0] = messages
        if n % 5 == 0 and first_attempt:
            raise StatusError(429, "rate limited")
        return "The answer is " + chr(65 + n % 5)

    return predict


def failing_judge():
    """``parity_judge`` that rejects prompts whose number of characters is divisible by 3."""
    judge = parity_judge()

    def predict(messages, **options):
        if len(user_text(messages)) % 3 == 0:
            raise StatusError(400, "judge is down")
        return judge(messages, **options)

    return predict
