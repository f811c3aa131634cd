"""firnline.operators"""
