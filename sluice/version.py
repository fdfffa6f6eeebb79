"""Build metadata; a build may write ``_build.py`` beside this file."""

import importlib
import importlib.util

VERSION, COMMIT, DATE = "0.1.0", "none", "unknown"
if importlib.util.find_spec(f"{__package__}._build"):
    _build = importlib.import_module(f"{__package__}._build")
    VERSION, COMMIT, DATE = _build.VERSION, _build.COMMIT, _build.DATE
