"""Every operator run over the driver's tables, each with an SQL text that must agree."""
