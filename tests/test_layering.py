"""The library stands without its llm subpackage."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_nothing_else_imports_llm():
    for file in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"corvane\.llm|from corvane import llm", file.read_text()), file
