"""Models and tokenizers of the caller, loaded once per Python worker."""

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle

_loaded: dict[str, Any] = {}


def named(loader: Callable[[], Any]) -> str:
    """A name that loaders share only if they are the same code over the same values; taken on the driver."""
    return hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()


def loaded(name: str, loader: Callable[[], Any]) -> Any:
    """What the loader returns; a worker that runs many tasks loads it once."""
    if name not in _loaded:
        _loaded[name] = loader()
    return _loaded[name]
