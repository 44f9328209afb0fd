"""File sources, sinks and the adapters over the test tables."""
