import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2] / "gacetilla"


def test_nothing_else_imports_this_folder():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"gacetilla\.llm|from \.+llm", p.read_text()), p
