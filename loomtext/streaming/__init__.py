"""Tables that follow a growing folder."""
