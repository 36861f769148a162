"""Expression builders over panels."""
