"""Jobs that run by themselves: ``python -m jobs.text_names`` and ``python -m jobs.layout_nets``."""
