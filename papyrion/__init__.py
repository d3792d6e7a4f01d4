"""papyrion: a Spark-first analytics engine for corpora of long documents."""

__version__ = "0.1.0"
