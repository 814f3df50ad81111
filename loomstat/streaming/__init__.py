"""Profiles of streams (an extension: see :mod:`loomstat.streaming.incremental`)."""
