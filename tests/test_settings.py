"""Sealed settings and run locks."""

from __future__ import annotations

import base64
import threading

import pytest

from gossamer.sources import settings as S


def test_keys_are_sealed_and_opened(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = S.Settings(spark, path, "secret of this machine")
    with pytest.raises(LookupError):
        s.get_key("pagespeed")
    s.set_key("pagespeed", "kéy-1")
    s.set_key("other", "x")
    s.set_key("pagespeed", "kéy-2")
    assert (s.get_key("pagespeed"), s.get_key("other")) == ("kéy-2", "x")
    assert "kéy" not in "".join(f.read_text() for f in (tmp_path / "s").glob("*.json"))
    with pytest.raises(S.Tampered):
        S.Settings(spark, path, "another secret").get_key("pagespeed")


def test_a_changed_value_is_not_opened(spark):
    sealed = S.seal(spark, "value", "secret")
    assert S.unseal(spark, sealed, "secret") == "value" and sealed != S.seal(spark, "value", "secret")
    raw = base64.b64decode(sealed)
    for at in (0, 20, len(raw) - 1):
        bad = raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]
        with pytest.raises(S.Tampered):
            S.unseal(spark, base64.b64encode(bad).decode(), "secret")
    for bad in ("", "no base64!", "AAAA"):
        with pytest.raises(S.Tampered):
            S.unseal(spark, bad, "secret")


def test_settings_that_are_torn(spark, tmp_path):
    s = S.Settings(spark, f"file://{tmp_path}/s", "secret")
    s.set_key("a", "b")
    (tmp_path / "s" / "settings-00000009.json").write_text("{")
    with pytest.raises(S.Tampered):
        s.get_key("a")


def test_one_job_runs_once(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    with S.locked(spark, path, "crawl", "https://e.com/a?x=1", {"depth": 3}):
        with pytest.raises(S.Running, match="is running"):
            S.acquire(spark, path, "crawl", "https://E.com/a/", {"depth": 3, "verbose": True})
        S.acquire(spark, path, "crawl", "https://e.com/a", {"depth": 4}).release()
        S.acquire(spark, path, "page", "https://e.com/a", {"depth": 3}).release()
        taken = S.acquire(spark, path, "crawl", "https://e.com/a", {"depth": 3}, force=True)
    # the first holder leaves what is not its own
    with pytest.raises(S.Running):
        S.acquire(spark, path, "crawl", "https://e.com/a", {"depth": 3})
    taken.release()
    S.acquire(spark, path, "crawl", "https://e.com/a", {"depth": 3}).release()


def test_stale_and_torn_locks_are_taken_over(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/l"
    old = S.acquire(spark, path, "crawl", "https://e.com", hold_s=10)
    now = S.time.time()
    monkeypatch.setattr(S.time, "time", lambda: now + 8)
    old.renew()
    monkeypatch.setattr(S.time, "time", lambda: now + 15)
    with pytest.raises(S.Running):
        S.acquire(spark, path, "crawl", "https://e.com")
    monkeypatch.setattr(S.time, "time", lambda: now + 30)
    new = S.acquire(spark, path, "crawl", "https://e.com")
    with pytest.raises(S.Running, match="taken over"):
        old.renew()
    new.release()
    (tmp_path / "l" / f"{S.job_name('crawl', 'https://e.com', {})}.lock").write_text("{")
    S.acquire(spark, path, "crawl", "https://e.com")
    assert S.clear(spark, path) == 1 and S.clear(spark, path) == 0


def test_of_many_starts_at_once_one_holds_the_lock(spark, tmp_path):
    got, path, gate = [], f"file://{tmp_path}/l", threading.Barrier(6)

    def start():
        gate.wait(30)
        try:
            got.append(S.acquire(spark, path, "crawl", "https://e.com"))
        except S.Running:
            got.append(None)

    threads = [threading.Thread(target=start) for _ in range(6)]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    assert len(got) == 6 and sum(x is not None for x in got) == 1
