import subprocess
import sys

from packhouse.llm import ship


def test_the_packed_package_can_be_imported(tmp_path):
    path = tmp_path / "code.zip"
    path.write_bytes(ship.packed())
    code = f"import sys; sys.path.insert(0, {str(path)!r}); import packhouse.llm.substrings as s; print(s.__file__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.startswith(str(path))


def test_shipping_twice_adds_once(spark, monkeypatch):
    ship.ship(spark)
    monkeypatch.setattr(ship, "packed", None)
    ship.ship(spark)
    assert ship.shipped(lambda s, x: x + 1)(spark, 1) == 2
