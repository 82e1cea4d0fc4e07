"""Fixture trees: relative path -> content."""

from pathlib import Path

SPACE, B = b" ", b"b"

DIFF1 = {
    "1/AAA/BCB/CCC/a.txt": SPACE * 6,
    "1/AAA/ZAW/A/b/c/a_file.txt": SPACE * 2,
    "1/AAA/ZAW/D/e/f/b_file.txt": SPACE * 3,
    "2/AAA/BBB/CZC/a.txt": SPACE * 4,
    "3/AAA/BBB/CCC/a.txt": SPACE * 7,
    "4/AAA/BBB/CCC/a.txt": B * 6,
    "path1/AAA/BCB/CCC/a.txt": SPACE * 2,
    "path1/AAA/ZAW/A/b/c/a_file.txt": SPACE * 2,
    "path1/AAA/ZAW/D/e/f/b_file.txt": SPACE * 4,
    "path2/AAA/BCB/CCC/a.txt": SPACE * 3,
    "path2/AAA/ZAW/A/b/c/a_file.txt": SPACE * 2,
    "path2/AAA/ZAW/D/e/f/b_file.txt": SPACE * 4,
}
DIFF2 = {
    "1/AAA/BCB/CCC/a.txt": SPACE * 6,
    "1/AAA/ZAW/A/b/c/a_file.txt": SPACE * 2,
    "1/AAA/ZAW/D/e/f/b_file.txt": SPACE * 3,
    "2/AAA/BBB/CZC/a.txt": SPACE * 5,
    "3/AAA/BBB/CCC/a.txt": SPACE * 8,
    "4/AAA/BBB/CCC/a.txt": SPACE * 11,
    "path1/AAA/BCB/CCC/a.txt": SPACE * 2,
    "path1/AAA/BCB/CCC/b.txt": SPACE * 3,
    "path1/AAA/ZAW/A/b/c/a_file.txt": SPACE * 2,
    "path1/AAA/ZAW/D/e/f/b_file.txt": SPACE * 3,
    "path2/AAA/BCB/CCC/a.txt": SPACE * 5,
    "path2/AAA/ZAW/A/b/c/a_file.txt": SPACE * 2,
}
FOUR_LEVELS = {
    "AAA/BBB/CCC/a.txt": B * 5,
    "AAA/BBB/uuu.txt": SPACE * 18,
    "AAA/tttt.txt": SPACE * 4,
    "sss.txt": SPACE * 2,
}


def make_tree(root, files) -> str:
    for name, content in files.items():
        path = Path(root) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)
