"""loomwake.functions"""
