"""Set-based operators over the domain's tables."""
