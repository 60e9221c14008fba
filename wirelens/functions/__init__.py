"""Column functions: text, links, times, regions, bands, addresses, tolerant JSON."""
