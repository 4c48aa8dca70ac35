"""Free-text helpers for model outputs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_prompt_prefix(output: Column, prompt: Column) -> Column:
    return F.startswith(output, prompt)


def strip_prompt(output: Column, prompt: Column) -> Column:
    """Drop as many leading characters as the prompt has, prefix or not."""
    return output.substr(F.length(prompt) + 1, F.length(output))


def extract_dictionary(text: Column) -> Column:
    """First ``{...}`` of a text as map<string,string>, null if absent or invalid.

    The match is non-greedy and crosses lines; single quotes count as double
    quotes; a nested object is cut at its first brace and is therefore invalid.
    """
    body = F.replace(F.regexp_extract(text, r"(?s)\{.*?\}", 0), F.lit("'"), F.lit('"'))
    return F.when(
        F.length(body) > 0,
        F.from_json(
            body,
            "map<string,string>",
            {"mode": "PERMISSIVE", "allowSingleQuotes": "false"},
        ),
    )
