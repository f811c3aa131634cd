"""firnline.functions"""
