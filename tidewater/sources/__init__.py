"""Readers, writers and the bridge from the shared tables to series and meshes."""
