"""Sources, sinks, ledgers: text, JSON, HTML to typed rows."""
