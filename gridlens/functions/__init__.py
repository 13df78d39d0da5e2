"""gridlens subpackage."""
