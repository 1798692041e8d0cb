"""tidemill: a Spark-first engine that generates, reshapes and replays synthetic machine data."""

__version__ = "0.1.0"
