"""Encrypted settings, and locks that keep two runs of one job apart, in a folder that drivers share.

Both are small files of the driver. What is secret never becomes part of a query's plan, which logs would keep.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from gossamer.functions.url import normalize_one
from gossamer.sources.committed import Folder

SALT, NONCE, KEY, TAG_BITS = 16, 12, 32, 128
#: Options that make a run another job.
JOB_OPTIONS = ("limit", "depth", "output", "sitemap", "incremental", "detect_soft404", "detect_traps", "subdomains", "allowed", "denied", "proxy", "agent", "max_redirects", "rate", "max_bytes", "concurrency")


class Tampered(ValueError):
    """A sealed value was changed, or was sealed with another secret."""


def _cipher(spark: SparkSession, mode: str, secret: str, salt: bytes, nonce: bytes):
    jvm = spark.sparkContext._jvm
    key = hashlib.scrypt(secret.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=KEY)
    c = jvm.javax.crypto.Cipher.getInstance("AES/GCM/NoPadding")
    c.init({"ENCRYPT_MODE": 1, "DECRYPT_MODE": 2}[mode], jvm.javax.crypto.spec.SecretKeySpec(bytearray(key), "AES"), jvm.javax.crypto.spec.GCMParameterSpec(TAG_BITS, bytearray(nonce)))
    return c


def seal(spark: SparkSession, text: str, secret: str) -> str:
    """AES-256-GCM with a key that scrypt makes of the secret and a fresh salt."""
    salt, nonce = os.urandom(SALT), os.urandom(NONCE)
    data = bytes(_cipher(spark, "ENCRYPT_MODE", secret, salt, nonce).doFinal(bytearray(text.encode())))
    return base64.b64encode(salt + nonce + data).decode()


def unseal(spark: SparkSession, sealed: str, secret: str) -> str:
    try:
        raw = base64.b64decode(sealed, validate=True)
        salt, nonce, data = raw[:SALT], raw[SALT : SALT + NONCE], raw[SALT + NONCE :]
        if len(data) < TAG_BITS // 8:
            raise ValueError("too short")
        return bytes(_cipher(spark, "DECRYPT_MODE", secret, salt, nonce).doFinal(bytearray(data))).decode()
    except Exception as e:
        raise Tampered("the value cannot be opened") from e


class Settings:
    """Sections of settings below a folder; keys are sealed. Every change is a new file, the last one counts."""

    def __init__(self, spark: SparkSession, path: str, secret: str):
        self.spark, self.secret, self.folder = spark, secret, Folder(spark, path)

    def _last(self) -> tuple[int, dict]:
        numbers = [int(n[9:-5]) for n in self.folder.names("") if n.startswith("settings-") and n.endswith(".json")]
        if not numbers:
            return 0, {}
        try:
            return max(numbers), json.loads(self.folder.read(f"settings-{max(numbers):08d}.json"))
        except ValueError as e:
            raise Tampered("the settings are no JSON") from e

    def section(self, name: str) -> dict | None:
        return self._last()[1].get(name)

    def set_key(self, section: str, key: str) -> None:
        """A section's key, sealed; its other settings stay. Of two writers at once both are kept, one after the other."""
        sealed = seal(self.spark, key, self.secret)
        while True:
            n, all_ = self._last()
            all_[section] = {**all_.get(section, {}), "key": sealed, "created_at": int(time.time())}
            if self.folder.publish(f"settings-{n + 1:08d}.json", json.dumps(all_)):
                break
        for old in range(max(1, n - 5), n):
            self.folder.remove(f"settings-{old:08d}.json")

    def get_key(self, section: str) -> str:
        sealed = (self.section(section) or {}).get("key")
        if not isinstance(sealed, str):
            raise LookupError(f"no key is set for {section}")
        return unseal(self.spark, sealed, self.secret)


# -- locks ----------------------------------------------------------------------------------------


class Running(RuntimeError):
    """The same job is running."""


def job_name(command: str, target: str, options: dict) -> str:
    """One name for all runs of a command on a target with options that matter."""
    url = normalize_one(target, strip_query=not options.get("query")) or target
    kept = {k: options[k] for k in JOB_OPTIONS if options.get(k) is not None}
    return hashlib.sha256(json.dumps({"command": command, "target": url, "options": kept}, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Lock:
    folder: Folder
    name: str
    owner: str
    hold_s: float

    def renew(self) -> None:
        """Say that the run is alive; it has to, before ``hold_s`` are over."""
        if _holder(self.folder, self.name).get("owner") != self.owner:
            raise Running("the lock has been taken over")
        self.folder.publish(f"{self.name}.{self.owner}.{int(time.time() * 1000)}", "")

    def release(self) -> None:
        if _holder(self.folder, self.name).get("owner") == self.owner:
            self.folder.remove(f"{self.name}.lock")
        for n in self.folder.names(""):
            if n.startswith(f"{self.name}.{self.owner}."):
                self.folder.remove(n)


def _holder(folder: Folder, name: str) -> dict:
    """Who holds a lock; a torn file is held by nobody."""
    try:
        return json.loads(folder.read(f"{name}.lock")) if f"{name}.lock" in folder.names("") else {}
    except ValueError:
        return {}


def _last_sign(folder: Folder, name: str, held: dict) -> float:
    beats = [int(n.rsplit(".", 1)[-1]) / 1000 for n in folder.names("") if n.startswith(f"{name}.{held.get('owner')}.")]
    return max([held.get("started_at", 0.0), *beats])


def acquire(spark: SparkSession, path: str, command: str, target: str, options: dict | None = None, force: bool = False, hold_s: float = 3600.0) -> Lock:
    """The lock of a job, or Running. A lock whose holder has given no sign for ``hold_s`` is stale and taken over, as any is with ``force``.

    Drivers may be on different machines, so a sign of life is a file, not a process id.
    """
    folder, name = Folder(spark, path), job_name(command, target, options or {})
    if f"{name}.lock" in folder.names(""):
        held = _holder(folder, name)
        if not force and held and time.time() - _last_sign(folder, name, held) <= held.get("hold_s", hold_s):
            raise Running(f"{command} is running for {target} since {time.ctime(held['started_at'])}")
        folder.remove(f"{name}.lock")
    owner = uuid.uuid4().hex
    if not folder.publish(f"{name}.lock", json.dumps({"owner": owner, "started_at": time.time(), "hold_s": hold_s, "command": command, "target": target})):
        raise Running(f"{command} has just been started for {target}")
    return Lock(folder, name, owner, hold_s)


@contextmanager
def locked(spark: SparkSession, path: str, command: str, target: str, options: dict | None = None, **kw):
    lock = acquire(spark, path, command, target, options, **kw)
    try:
        yield lock
    finally:
        lock.release()


def clear(spark: SparkSession, path: str) -> int:
    """Removes all locks; how many there were."""
    folder = Folder(spark, path)
    names = [n for n in folder.names("") if ".lock" in n or len(n.split(".")) == 3]
    for n in names:
        folder.remove(n)
    return sum(n.endswith(".lock") for n in names)
