"""pocketlake: buried-pocket screening of protein structures as Spark jobs."""

__version__ = "0.1.0"
