"""Records and digests for the tests; contents of our own."""

LONG = "teach the tide gauge importer to skip frozen readings after a sensor reset"
ACTIVITY = [
    ("sea/harbor", [
        {"sha": "a1b2c3d4e5", "message": "parse tide tables from the coastal feed\n\nbody", "files": [
            {"filename": "src/tides.py", "additions": 12, "deletions": 3, "patch": "+def parse_tides(feed):\n+    return rows"},
            {"filename": "yarn.lock", "additions": 900, "deletions": 1, "patch": "+secretlock"}]},
        {"sha": "b2", "message": LONG, "files": []}]),
    ("sea/lantern", [{"sha": "c3", "message": "dim beacon lamps at dawn using lux thresholds", "files": None}]),
]
GOOD = """# Developer Journal

## Summary

Work on the harbor moved to parsing tide tables from the coastal feed, while the lantern learned to dim its beacon lamps at dawn.

## Per-Repo Activity

### harbor

The importer now understands tide tables published by the coastal feed, with frozen readings skipped after sensor resets.

### lantern

Beacon lamps dim at dawn once lux thresholds are crossed, which saves night power.
"""
#: Inputs that no digest looks like: of every kind that a scorer may meet, contents of our own.
ODD = [
    "", " ", "\r", "\u2028\u2029", "####", "## ", "### \n## \n### ", "## Summary\n## Summary\n## Per-Repo Activity", "\n".join(f"### quay{k % 4}" for k in range(90)),
    "kelp " * 900, "\n".join(["Ω≈ñ ﬁ שלום ١٢٣ \u0301e 🐙"] * 12), "## Per-Repo Activity\n### sea/buoy\n" + "~" * 3000 + "q" * 3000,
    "one\rtwo\x0bthree\x0cfour\x1cfive\u0085six\r\nseven", "### sea/buoy\n\n" + "\n".join(f"* [{'x' if k % 2 else ' '}] item {k}" for k in range(70)),
]
VARIANTS = [
    GOOD, *ODD,
    GOOD.replace("### harbor", "### sea/harbor"), GOOD.replace("### lantern", "### ghost"), GOOD.replace("### lantern", "### harbor"),
    GOOD.replace("saves night power", "saves night power. See src/app/Widget.svelte and node.js and tides.py"), GOOD + "\nNext steps: you should rest.",
    GOOD.replace("Work on", "Three active repos: work on"), GOOD.replace("Work on", "Two git repos: work on"), GOOD.replace("Work on", "GPT-2 and llama.cpp: work on"),
    GOOD.replace("## Per-Repo Activity\n", "## Per-Repo Activity\n\nstray prose about ghost.py here\n"), GOOD.replace("## Per-Repo Activity\n", ""),
    GOOD.replace("Beacon lamps dim", "fragment here again " * 20 + "Beacon lamps dim"),
    GOOD.replace("Work on the harbor", LONG).replace("The importer now", LONG + ". The importer now"),
    GOOD.replace("Beacon lamps dim at dawn once lux thresholds are crossed, which saves night power.", "Work on the harbor moved to parsing tide tables from the coastal feed, while all slept."),
    GOOD + "\n### \nlost words\n### lantern two\nbody\n## Notes\nno\n## Per-Repo Activity\nkept orphan",
    "### a/b\nx\n## Per-Repo Activity\norphan one\n## Other\n### lantern\ndim beacon lamps dawn\x85lux\x1cthresholds", GOOD.replace("\n", "\r\n"),
]
